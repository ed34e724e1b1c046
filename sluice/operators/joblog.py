"""A durable job log: an append-only table of events, folded into job and item states.

Nothing is updated in place. Each call appends rows (job_id, position, seq, kind, state, details, at); the state of an
item is that of its last event. Position -1 stands for the job itself. Appends by one driver are ordered by seq.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import save

# The states.
ITEM_STATES = ["pending", "running", "completed", "completed_with_warning", "skipped", "failed", "quarantined"]
TERMINAL = ["completed", "completed_with_warning", "skipped", "quarantined"]
SCHEMA = "job_id string, position int, seq long, kind string, state string, path string, details string, at double"
JOB = -1


def job_id(tool: str, versions: list[str], inputs: list[tuple[str, int | None, int | None]], settings: dict, max_retries: int = 0) -> str:
    """24 digits from canonical JSON of all that the job depends on: a changed input, setting or version is another job."""
    text = json.dumps({"tool": tool, "versions": versions, "inputs": inputs, "settings": settings, "max_retries": max_retries}, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def final_state(counts: dict[str, int]) -> str:
    """Of a job whose items are all done: completed, or with warnings where any item did not simply complete."""
    if any(counts.get(s, 0) for s in ("pending", "running", "failed")):
        return "running"
    return "completed_with_warnings" if any(counts.get(s, 0) for s in ("completed_with_warning", "skipped", "quarantined")) else "completed"


class JobLog:
    """A log at a path. A second log on the same path, such as that of a restarted driver, goes on where the first was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)
        self.seq = self.events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def append(self, rows: list[tuple]) -> None:
        """rows: (job_id, position, kind, state, path, details), few of them."""
        now, full = time.time(), []
        for job, position, kind, state, path, details in rows:
            self.seq += 1
            full.append((job, position, self.seq, kind, state, path, details, now))
        self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def append_all(self, rows: DataFrame) -> None:
        """rows (job_id, position, kind, state, path, details) of any number, at most one for each item."""
        self.seq += 1
        full = rows.select("job_id", "position", F.lit(self.seq).cast("long").alias("seq"), "kind", "state", "path", "details", F.lit(time.time()).alias("at"))
        full.write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def prepare(self, job: str, paths: DataFrame) -> str:
        """paths (position, path): 'new', 'complete' (nothing to do) or 'recovered', where the log has other work of this
        job: items that were running wait again and keep their attempts. Other paths under a known job are an error."""
        known = save(self.items(job).select("job_id", "position", "path", "state"), "known")  # asked four times
        if known.isEmpty():
            self.append_all(paths.select(F.lit(job).alias("job_id"), F.col("position").cast("int"), F.lit("add").alias("kind"), F.lit("pending").alias("state"), "path", F.lit("").alias("details")))
            self.append([(job, JOB, "state", "queued", None, "")])
            return "new"
        if not self.same_inputs(job, paths, known):
            raise ValueError(f"job {job} is known with other inputs")
        if known.where(~F.col("state").isin(TERMINAL)).isEmpty():
            return "complete"
        stuck = known.where("state = 'running'")
        self.append_all(stuck.select("job_id", "position", F.lit("recover").alias("kind"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("path"), F.lit("").alias("details")))
        self.append([(job, JOB, "state", "recovered", None, "")])
        return "recovered"

    def same_inputs(self, job: str, paths: DataFrame, items: DataFrame | None = None) -> bool:
        """Whether the stored items of a job (`items`, where they are at hand) are just these (position, path)."""
        stored = (items or self.items(job)).select("position", "path", F.lit(1).alias("n"))
        both = stored.unionAll(paths.select(F.col("position").cast("int"), "path", F.lit(-1)))
        return both.groupBy("position", "path").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()

    def submit(self, job: str, paths: list[str]) -> str:
        """prepare() for a list; an empty one stands for the stored paths."""
        if paths or self.items(job).isEmpty():
            return self.prepare(job, self.spark.createDataFrame(list(enumerate(paths)), "position int, path string"))
        return self.prepare(job, self.items(job).select("position", "path"))

    def items(self, job: str | None = None) -> DataFrame:
        """job_id, position, path, state, attempts (begins since the last reset), details, updated_at."""
        rows = self.events().where(F.col("position") != JOB)
        rows = rows.where(F.col("job_id") == job) if job else rows
        # Of numbers, so that Spark hashes rather than sorts; a state goes with the number of its event.
        number = F.array_position(F.array(*map(F.lit, ITEM_STATES)), F.col("state")) - 1
        last = rows.groupBy("job_id", "position").agg(
            F.max(F.col("seq") * len(ITEM_STATES) + number).alias("top"), F.max("path").alias("path"), F.max_by("details", "seq").alias("details"), F.max("at").alias("updated_at"),
            F.coalesce(F.max(F.when(F.col("kind") == "reset", F.col("seq"))), F.lit(0)).alias("since"), F.collect_list(F.when(F.col("kind") == "begin", F.col("seq"))).alias("begins"),
        )
        state = F.element_at(F.array(*map(F.lit, ITEM_STATES)), (F.col("top") % len(ITEM_STATES) + 1).cast("int"))
        attempts = F.size(F.filter("begins", lambda s: s > F.col("since")))
        return last.select("job_id", "position", "path", state.alias("state"), attempts.alias("attempts"), "details", "updated_at")

    def one(self, job: str, position: int) -> dict:
        found = self.items(job).where(F.col("position") == position).first()
        if found is None:
            raise KeyError((job, position))
        return found.asDict()

    def begin(self, job: str, position: int) -> int:
        item = self.one(job, position)
        if item["state"] not in ("pending", "running"):
            raise KeyError((job, position, item["state"]))
        self.append([(job, position, "begin", "running", None, "")])
        return item["attempts"] + 1

    def finish(self, job: str, position: int, state: str, details: str = "") -> None:
        if state not in ITEM_STATES or self.one(job, position)["state"] != "running":
            raise KeyError((job, position))
        self.append([(job, position, "finish", state, None, details)])

    def defer(self, job: str, position: int, details: str = "") -> None:
        if self.one(job, position)["state"] != "running":
            raise KeyError((job, position))
        self.append([(job, position, "defer", "pending", None, details)])

    def reset(self, job: str, positions: list[int]) -> None:
        self.append([*[(job, p, "reset", "pending", None, "") for p in positions], (job, JOB, "state", "recovered", None, "")])

    def advance(self, rows: DataFrame) -> DataFrame:
        """rows (job_id, position, kind, details) of any number, at most one for each item: begin, finish (with `state`, the
        outcome), defer and reset are logged for the items whose state allows it, in one append; returns the others with
        the state that they were refused in (null: no such item). Nothing goes through the driver."""
        now = self.items().select("job_id", "position", F.col("state").alias("was"))
        rows = rows if "state" in rows.columns else rows.withColumn("state", F.lit(None).cast("string"))
        both = rows.select("job_id", F.col("position").cast("int"), "kind", "state", F.coalesce("details", F.lit("")).alias("details")).join(now, ["job_id", "position"], "left")
        fits = F.when(F.col("kind") == "begin", F.col("was").isin("pending", "running")).when(F.col("kind") == "finish", (F.col("was") == "running") & F.col("state").isin(ITEM_STATES))
        fits = fits.when(F.col("kind") == "defer", F.col("was") == "running").when(F.col("kind") == "reset", F.col("was").isNotNull())
        both = save(both.withColumn("fits", F.coalesce(fits, F.lit(False))), "advance")
        to = F.when(F.col("kind") == "begin", "running").when(F.col("kind") == "finish", F.col("state")).otherwise("pending")
        self.append_all(both.where("fits").select("job_id", "position", "kind", to.alias("state"), F.lit(None).cast("string").alias("path"), "details"))
        return both.where("NOT fits").select("job_id", "position", "kind", "was")

    def set_state(self, job: str, state: str) -> None:
        self.append([(job, JOB, "state", state, None, "")])

    def counts(self) -> DataFrame:
        """job_id, state, n for every state of every job, zeros too."""
        states = self.spark.createDataFrame([(s,) for s in ITEM_STATES], "state string")
        jobs = self.items().select("job_id").distinct().crossJoin(F.broadcast(states))  # seven states
        found = self.items().groupBy("job_id", "state").agg(F.count("*").alias("c"))
        return jobs.join(found, ["job_id", "state"], "left").select("job_id", "state", F.coalesce("c", F.lit(0)).alias("n"))

    def pending(self, job: str) -> DataFrame:
        return self.items(job).where("state = 'pending'").orderBy("position")

    def reports(self, limit: int = 100) -> DataFrame:
        """The latest jobs, their state and their items as an array in order; none for a limit of 0 or less."""
        jobs = self.events().groupBy("job_id").agg(F.max_by("state", F.when(F.col("position") == JOB, F.col("seq"))).alias("state"), F.max("seq").alias("last"))
        top = jobs.orderBy(F.desc("last")).limit(max(0, limit))
        items = self.items().groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("position", "path", "state", "attempts", "details"))).alias("items"))
        return top.join(items, "job_id", "left").orderBy(F.desc("last"))


class VolatileJobLog(JobLog):
    """The same log for one session, kept by the driver: nothing is written, and reports end with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seq, self.rows = spark, 0, []

    def append(self, rows: list[tuple]) -> None:
        for job, position, kind, state, path, details in rows:
            self.seq += 1
            self.rows.append((job, position, self.seq, kind, state, path, details, time.time()))

    def append_all(self, rows: DataFrame) -> None:
        self.append([tuple(r) for r in rows.select("job_id", "position", "kind", "state", "path", "details").collect()])  # a session's items

    def events(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)


def run_batch(log: JobLog, job: str, work, max_retries: int = 0) -> dict[str, int]:
    """Runs the waiting items of a job on the executors, in rounds of one Spark job each; work(path) returns (state,
    details, retryable) and goes to the executors with all that it needs.

    All waiting items are begun, worked on and logged by the tasks that did so; a failure is tried again in the next
    round while it is retryable and attempts do not exceed max_retries, then quarantined; an exception is a failure.
    A driver that dies leaves items running, which prepare() hands out again. Returns the counts.
    """
    import pyarrow as pa

    def outcomes(it):
        for b in it:
            rows = []
            for j, position, path, tried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    state, details, again = work(path)
                except Exception as e:  # noqa: BLE001  any failure of an item is its outcome
                    state, details, again = "failed", f"{type(e).__name__}: {e}", False
                if state == "failed":
                    state = "pending" if again and tried + 1 <= max_retries else "quarantined"
                rows.append((j, position, "defer" if state == "pending" else "finish", state, None, details))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["job_id", "position", "kind", "state", "path", "details"])

    for _ in range(max_retries + 1):
        waiting = save(log.items(job).where("state = 'pending'").select("job_id", "position", "path", "attempts"), "waiting")
        if waiting.isEmpty():
            break
        log.append_all(waiting.select("job_id", "position", F.lit("begin").alias("kind"), F.lit("running").alias("state"), F.lit(None).cast("string").alias("path"), F.lit("").alias("details")))
        log.append_all(save(waiting.mapInArrow(outcomes, "job_id string, position int, kind string, state string, path string, details string"), "outcomes"))
    counts = {r["state"]: r["n"] for r in log.counts().where(F.col("job_id") == job).collect()}  # a row a state
    log.set_state(job, final_state(counts))
    return counts
