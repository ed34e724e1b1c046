"""Items of batch jobs as a stateful stream: guards, retries that back off, timeouts, and rejected events as a second output.

Each item (job_id, position) is a small state machine. What is said of it is an event; a timer of its own says that it ran
too long (`timeout`) or has waited long enough for its next try (`ready`). State is a value and a list in the stream's
state store, timers are event time ones. Results do not depend on how events are cut into batches: before an event an item's
due timers fire, in order of time, and the store's timers only serve items of which nothing more is said.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import new_path

# In which states an event may be said, and the state that it leads to; waiting items keep a begin for later.
MOVES = {
    "add": ((None,), "pending"), "begin": (("pending", "running"), "running"), "complete": (("running",), "completed"), "warn": (("running",), "completed_with_warning"), "skip": (("running",), "skipped"),
    "fail": (("running",), "waiting"), "timeout": (("running",), "waiting"), "ready": (("waiting",), "pending"), "reset": (("completed", "completed_with_warning", "skipped", "quarantined", "pending"), "pending"),
}
TIMERS = ("timeout", "ready")
OUTPUT = "job_id string, position long, seq long, at long, kind string, state string, attempts int, accepted boolean"
HAPPENED = Row(*[c.split()[0] for c in OUTPUT.split(", ")])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """How often a failed item is tried again, how long it waits before that (doubled with each try) and how long it may run;
    in milliseconds."""

    max_retries: int = 2
    back_off: int = 60_000
    time_out: int = 3_600_000


@dataclass
class Item:
    state: str | None = None
    attempts: int = 0
    last: int = -1
    deadline: int | None = None
    held: list[int] = field(default_factory=list)

    def hear(self, policy: Policy, seq: int | None, at: int, kind: str) -> Iterator[tuple]:
        """(seq, at, kind, state, attempts, accepted) for what happens to the item now. What may not be said in its state
        changes nothing; events from outside cannot name a timer's kinds."""
        if kind == "begin" and self.state == "waiting":
            self.held.append(seq)
            return
        allowed, target = MOVES.get(kind, ((), None))
        if self.state not in allowed or seq is not None and kind in TIMERS:
            yield seq, at, kind, self.state, self.attempts, False
            return
        self.state, self.deadline = target, None
        if kind == "begin":
            self.attempts += 1
            self.deadline = at + policy.time_out
        elif kind == "reset":
            self.attempts = 0
        elif target == "waiting":
            if self.attempts > policy.max_retries:
                self.state = "quarantined"
            else:
                self.deadline = at + policy.back_off * 2 ** (self.attempts - 1)
        yield seq, at, kind, self.state, self.attempts, True
        if kind == "ready":
            held, self.held = self.held, []
            for s in held:
                yield from self.hear(policy, s, at, "begin")

    def until(self, policy: Policy, at: int) -> Iterator[tuple]:
        """What the item's timers that are due at this time do, each at its own time."""
        while self.deadline is not None and self.deadline <= at:
            yield from self.hear(policy, None, self.deadline, "timeout" if self.state == "running" else "ready")


class ItemMachine(StatefulProcessor):
    """Keeps one Item a key; see advance()."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempts int, last long, deadline long")
        self.held = handle.getListState("held", "seq long")

    def load(self) -> Item:
        if not self.item.exists():
            return Item()
        state, attempts, last, deadline = self.item.get()
        return Item(state, attempts, last, deadline, [r[0] for r in self.held.get()] if self.held.exists() else [])

    def store(self, item: Item, before: Item) -> None:
        self.item.update((item.state, item.attempts, item.last, item.deadline))
        if item.held != before.held:
            self.held.put([(s,) for s in item.held]) if item.held else self.held.clear()
        if item.deadline != before.deadline:
            if before.deadline is not None:
                self.handle.deleteTimer(before.deadline)
            if item.deadline is not None:
                self.handle.registerTimer(item.deadline)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """A known item: waiting and running ones have no deadline that could be known, and are pending again."""
        state = "pending" if initialState.state in ("running", "waiting") else initialState.state
        self.store(Item(state, int(initialState.attempts)), Item())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        item, before = self.load(), self.load()
        for seq, at, kind in sorted((r.seq, r.ms, r.kind) for r in rows):  # one item's part of a batch
            if seq > item.last:
                item.last = seq
                for out in (*item.until(self.policy, at), *item.hear(self.policy, seq, at, kind)):
                    yield HAPPENED(*key, *out)
        self.store(item, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        item, before = self.load(), self.load()
        for out in item.until(self.policy, timerValues.getCurrentWatermarkInMs()):
            yield HAPPENED(*key, *out)
        if before.deadline == expiredTimerInfo.getExpiryTimeInMs():
            before.deadline = None  # this timer is gone
        self.store(item, before)

    def close(self) -> None:
        pass


def advance(events: DataFrame, policy: Policy = Policy(), delay: str = "0 seconds", known: DataFrame | None = None) -> DataFrame:
    """events (job_id, position, seq, at, kind) as a stream of what happened to their items: OUTPUT, `at` in milliseconds,
    seq null for what a timer did.

    Of each item events count in order of seq; one whose seq is not beyond the item's last is a replay and passed over.
    Events that are later than `delay` behind the latest are dropped by the watermark. Rows with a null seq, time or kind
    are left out. known (job_id, position, state, attempts) says where items stand before the first event, once.
    """
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    rows = events.where("seq IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL")
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), F.col("position").cast("long").alias("position"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), ms.alias("ms"), F.col("kind").cast("string").alias("kind"))
    keyed = rows.withWatermark("at", delay).groupBy("job_id", "position")
    first = None
    if known is not None:
        columns = [F.col(c).cast(t).alias(c) for c, t in (("job_id", "string"), ("position", "long"), ("state", "string"), ("attempts", "int"))]
        first = known.select(*columns).groupBy("job_id", "position")
    return keyed.transformWithState(ItemMachine(policy), OUTPUT, "append", "eventTime", first)


def run(events: DataFrame, path: str, checkpoint: str, policy: Policy = Policy(), delay: str = "0 seconds", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Advances all items with what the stream has now; returns (accepted, rejected), all rows of these two tables.

    Both are written batch by batch beneath `path`, each batch to a folder of its own number that a second try replaces, so
    that a batch that is repeated after a failure counts once. A later run on the same checkpoint goes on from there.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # written twice; lost blocks are made anew from the state of the batch before
        for name, rows in (("accepted", batch.where("accepted")), ("rejected", batch.where("NOT accepted"))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # the store that has timers
    try:
        stream = advance(events, policy, delay, known).writeStream.outputMode("append").foreachBatch(write)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return tuple(spark.read.schema(OUTPUT).parquet(f"{path}/{name}").select(*HAPPENED) for name in ("accepted", "rejected"))


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job_id, position, state, attempts, last, deadline of all items, as the stream's state store has them."""
    return spark.read.format("statestore").option("stateVarName", "item").load(checkpoint).select("key.*", "value.*")


def timeline(events: DataFrame, policy: Policy) -> DataFrame:
    """Everything that happened to the items, accepted or not, of a stream that is read until it is exhausted."""
    spark = events.sparkSession
    accepted, rejected = run(events, new_path(spark, "timeline"), new_path(spark, "machine"), policy)
    return accepted.unionAll(rejected)
