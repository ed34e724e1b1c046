"""Job identity, item states and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .registry import query, table

# The states of an item.
STATES = ["pending", "running", "completed", "failed", "quarantined"]
STATE_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END"


def state_of(event_type):
    return F.when(event_type == "signup", "pending").when(event_type == "purchase", "completed").when(event_type == "error", "failed").otherwise("running")


@query("""SELECT o_orderkey, substring(sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}'), 1, 24) AS job_id FROM orders""")
def job_identity(spark, sf_dir):
    """The first 24 digits of the SHA-256 of canonical JSON: keys sorted, no blanks."""
    text = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.sha2(text, 256), 1, 24).alias("job_id"))


@query(
    f"""WITH last AS (SELECT user_id, arg_max({STATE_SQL}, event_id) AS s, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
fin AS (SELECT CASE WHEN s = 'failed' AND errors > 3 THEN 'quarantined' ELSE s END AS state FROM last)
SELECT d.state, count(fin.state) AS n FROM (VALUES {', '.join(f"('{s}')" for s in STATES)}) AS d(state) LEFT JOIN fin ON fin.state = d.state GROUP BY 1"""
)
def item_state_counts(spark, sf_dir):
    """The last state of each item; failures past the third try are quarantined; states that none has count 0."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by(state_of(F.col("event_type")), "event_id").alias("s"), F.count_if(F.col("event_type") == "error").alias("errors"))
    found = last.groupBy(F.when((F.col("s") == "failed") & (F.col("errors") > 3), "quarantined").otherwise(F.col("s")).alias("state")).agg(F.count("*").alias("c"))
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(found, "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("n"))


@query(
    """WITH m AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS op, count(*) AS passes, round(CAST(sum(coalesce(value, 0)) AS DOUBLE), 4) AS amount FROM i GROUP BY 1, 2"""
)
def compact_passes(spark, sf_dir):
    """Passes that do nothing are left out; neighbours of one kind become one."""
    passes = table(spark, sf_dir, "events").where("event_type != 'view'").select("user_id", "event_id", "event_type", "value")
    runs = tables.islands(passes, "user_id", ["event_id"], "event_type")
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("op"), F.count("*").alias("passes"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("amount"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1")
def job_stream(spark, sf_dir):
    """The same fold as a stream: events are read incrementally and each user's last state and tries are kept as state."""
    from ..streaming.jobs import fold_events

    return fold_events(spark, sf_dir)


# Users as items: what an event says of one. R retries, B ms before the first of them, T ms to run.
R, B, T = 2, 3_600_000, 36_000_000
KIND_SQL = "CASE event_type WHEN 'view' THEN 'add' WHEN 'signup' THEN 'begin' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'reset' ELSE 'complete' END ELSE 'skip' END"


@query(
    f"""WITH RECURSIVE ev AS (SELECT user_id, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, {KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT max(at_ms) AS w FROM ev),
m AS (SELECT DISTINCT user_id, 1::BIGINT AS n, NULL::VARCHAR AS state, 0 AS attempts, NULL::BIGINT AS deadline, []::BIGINT[] AS held, NULL::BIGINT AS seq, NULL::BIGINT AS at_ms, NULL::VARCHAR AS kind, NULL::BOOLEAN AS accepted, []::BIGINT[] AS released, true AS silent FROM ev
UNION ALL
SELECT user_id, CASE WHEN due THEN n ELSE n + 1 END,
  CASE WHEN keep OR NOT ok THEN state WHEN what IN ('fail', 'timeout') THEN CASE WHEN attempts > {R} THEN 'quarantined' ELSE 'waiting' END
    WHEN what = 'ready' THEN CASE WHEN len(held) > 0 THEN 'running' ELSE 'pending' END WHEN what IN ('add', 'reset') THEN 'pending' WHEN what = 'begin' THEN 'running' WHEN what = 'complete' THEN 'completed' ELSE 'skipped' END,
  CASE WHEN keep OR NOT ok THEN attempts WHEN what = 'begin' THEN attempts + 1 WHEN what = 'ready' THEN attempts + len(held) WHEN what = 'reset' THEN 0 ELSE attempts END::INTEGER,
  CASE WHEN keep OR NOT ok THEN deadline WHEN what IN ('fail', 'timeout') AND attempts <= {R} THEN now + {B} * (1 << (attempts - 1)) WHEN what = 'begin' OR what = 'ready' AND len(held) > 0 THEN now + {T} END::BIGINT,
  CASE WHEN keep THEN list_append(held, next) WHEN what = 'ready' THEN [] ELSE held END, CASE WHEN due THEN NULL ELSE next END, now, what, ok, CASE WHEN what = 'ready' THEN held ELSE [] END, keep
FROM (SELECT *, state = 'waiting' AND what = 'begin' AND NOT due AS keep, coalesce(CASE WHEN what = 'add' THEN state IS NULL WHEN what = 'begin' THEN state IN ('pending', 'running') WHEN what = 'ready' THEN state = 'waiting'
    WHEN what = 'reset' THEN state IN ('completed', 'skipped', 'quarantined', 'pending') ELSE state = 'running' END, false) AS ok
  FROM (SELECT *, CASE WHEN NOT due THEN said WHEN state = 'running' THEN 'timeout' ELSE 'ready' END AS what, CASE WHEN due THEN deadline ELSE upcoming END AS now
    FROM (SELECT m.user_id, m.n, m.state, m.attempts, m.deadline, m.held, e.seq AS next, e.at_ms AS upcoming, e.kind AS said, coalesce(m.deadline <= coalesce(e.at_ms, w.w), false) AS due FROM m LEFT JOIN ev e ON e.user_id = m.user_id AND e.n = m.n CROSS JOIN w)
    WHERE due OR next IS NOT NULL)))
SELECT user_id, seq, at_ms, kind, CASE WHEN kind = 'ready' THEN 'pending' ELSE state END AS state, CASE WHEN kind = 'ready' THEN attempts - len(released) ELSE attempts END::INTEGER AS attempts, accepted FROM m WHERE NOT coalesce(silent, false)
UNION ALL SELECT user_id, released[i], at_ms, 'begin', 'running', (attempts - len(released) + i)::INTEGER, true FROM (SELECT *, unnest(range(1, len(released) + 1)) AS i FROM m WHERE kind = 'ready' AND accepted)"""
)
def item_timeline(spark, sf_dir):
    """What happened to each item and when: events in their order, held ones, timeouts, tries after a pause, and rejections."""
    from ..streaming import jobs, machine

    events = spark.readStream.schema(jobs.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    said = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "error", "fail")
    said = said.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "reset").when(F.col("event_type") == "purchase", "complete").otherwise("skip")
    told = events.select(F.lit("users").alias("job_id"), F.col("user_id").alias("position"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), said.alias("kind"))
    done = machine.timeline(told, machine.Policy(R, B, T))
    return done.select(F.col("position").alias("user_id"), "seq", F.col("at").alias("at_ms"), "kind", "state", "attempts", "accepted")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def published_orders(spark, sf_dir):
    """Orders, written as parts that one marker makes visible, and read back with each part's digest checked."""
    from ..sources import reports

    path = tables.new_path(spark, "published")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    reports.publish_rows(orders, path)
    return reports.published(spark, path)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'view'")
def published_stream(spark, sf_dir):
    """A stream's rows, published batch by batch, each of which counts once."""
    from ..sources import reports
    from ..streaming.jobs import EVENTS

    path = tables.new_path(spark, "published")
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    reports.publish_stream(events.where("event_type != 'view'").select("event_id", "user_id", "event_type", "value"), path, tables.new_path(spark, "check"))
    return reports.published(spark, path)


# Orders as items of one job for each status. What a run says of each item, step by step; another run recovers what it left.
STEPS = [("begin", "c % 5 > 0", None), ("finish", "c % 5 = 1", "completed"), ("finish", "c % 5 = 2", "completed_with_warning"), ("finish", "c % 7 = 3", "skipped"), ("defer", "c % 11 = 4", None)]
AGAIN = [("begin", "c % 4 = 0", None), ("finish", "c % 8 = 0", "quarantined"), ("reset", "c % 9 = 1", None)]


def logged_orders(spark, sf_dir):
    """The log after both runs, and all that was refused."""
    from ..operators.joblog import JobLog

    path = tables.new_path(spark, "log")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("job-"), "o_orderstatus").alias("job_id"), F.col("o_orderkey").cast("int").alias("position"), F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("c"))
    jobs = sorted(r[0] for r in orders.select("job_id").distinct().collect())  # three
    refused = []
    for run, steps in enumerate((STEPS, AGAIN)):
        log = JobLog(spark, path)
        for job in jobs:
            assert log.prepare(job, orders.where(F.col("job_id") == job).select("position", "path")) == ("recovered" if run else "new")
        for step, (kind, chosen, state) in enumerate(steps):
            rows = orders.where(chosen).select("job_id", "position", F.lit(kind).alias("kind"), F.lit(state).cast("string").alias("state"), F.lit(f"step {step}").alias("details"))
            refused.append(log.advance(rows).withColumn("step", F.lit(10 * run + step)))
    for job in jobs:
        log.set_state(job, "cancelled" if job.endswith("P") else "running")
    return log, refused


S0 = "SELECT 'job-' || o_orderstatus AS job_id, CAST(o_orderkey AS INTEGER) AS position, o_custkey AS c, 'in/' || o_orderkey AS path FROM orders"
S1 = f"SELECT *, c % 5 > 0 AS b, CASE WHEN c % 5 = 0 THEN 'pending' WHEN c % 5 = 1 THEN 'completed' WHEN c % 5 = 2 THEN 'completed_with_warning' WHEN c % 7 = 3 THEN 'skipped' WHEN c % 11 = 4 THEN 'pending' ELSE 'running' END AS was1 FROM ({S0})"
S2 = f"SELECT *, CASE WHEN was1 = 'running' THEN 'pending' ELSE was1 END AS start2 FROM ({S1})"
S3 = f"SELECT *, c % 4 = 0 AND start2 = 'pending' AS b2, CASE WHEN c % 4 = 0 AND start2 = 'pending' THEN CASE WHEN c % 8 = 0 THEN 'quarantined' ELSE 'running' END ELSE start2 END AS was2 FROM ({S2})"
LOGGED = f"SELECT *, CASE WHEN c % 9 = 1 THEN 'pending' ELSE was2 END AS state, CAST(CASE WHEN c % 9 = 1 THEN 0 ELSE CAST(b AS INTEGER) + CAST(b2 AS INTEGER) END AS INTEGER) AS attempts FROM ({S3})"


@query(f"SELECT job_id, position, path, state, attempts FROM ({LOGGED})")
def job_log_items(spark, sf_dir):
    """Every item after two runs of a job, the second of which recovers what the first left running."""
    return logged_orders(spark, sf_dir)[0].items().select("job_id", "position", "path", "state", "attempts")


@query(
    f"""WITH s AS ({LOGGED})
SELECT 1 AS step, job_id, position, CASE WHEN c % 5 = 0 THEN 'pending' END AS was FROM s WHERE FALSE
UNION ALL SELECT 3, job_id, position, CASE WHEN c % 5 = 0 THEN 'pending' WHEN c % 5 = 1 THEN 'completed' ELSE 'completed_with_warning' END FROM s WHERE c % 7 = 3 AND c % 5 < 3
UNION ALL SELECT 4, job_id, position, CASE WHEN c % 5 = 0 THEN 'pending' WHEN c % 5 = 1 THEN 'completed' WHEN c % 5 = 2 THEN 'completed_with_warning' ELSE 'skipped' END FROM s WHERE c % 11 = 4 AND (c % 5 < 3 OR c % 7 = 3)
UNION ALL SELECT 10, job_id, position, start2 FROM s WHERE c % 4 = 0 AND start2 <> 'pending' UNION ALL SELECT 11, job_id, position, start2 FROM s WHERE c % 8 = 0 AND start2 <> 'pending'"""
)
def job_log_refusals(spark, sf_dir):
    """What was said of items in a state that does not allow it, and that state."""
    refused = logged_orders(spark, sf_dir)[1]
    out = refused[0]
    for more in refused[1:]:
        out = out.unionByName(more)
    return out.select("step", "job_id", "position", "was")


@query(
    f"""WITH s AS ({LOGGED}), n AS (SELECT job_id, state, count(*) AS n FROM s GROUP BY 1, 2)
SELECT j.job_id, t.state, coalesce(n.n, 0) AS n, CASE WHEN j.job_id = 'job-P' THEN 'cancelled' ELSE 'running' END AS job_state, first FROM (SELECT job_id, min(position) FILTER (state = 'pending') AS first FROM s GROUP BY 1) j
CROSS JOIN (VALUES ('pending'), ('running'), ('completed'), ('completed_with_warning'), ('skipped'), ('failed'), ('quarantined')) t(state) LEFT JOIN n ON n.job_id = j.job_id AND n.state = t.state"""
)
def job_log_report(spark, sf_dir):
    """The latest jobs with how many items are in each state, and the first item that waits."""
    log = logged_orders(spark, sf_dir)[0]
    jobs = log.reports(10).select("job_id", F.col("state").alias("job_state"))
    first = log.items().where("state = 'pending'").groupBy("job_id").agg(F.min("position").alias("first"))
    return log.counts().join(jobs, "job_id").join(first, "job_id", "left").select("job_id", "state", "n", "job_state", "first")


@query()
def image_kernels(spark, sf_dir):
    """Kernels over images made from the vectors of `embeddings`: mean, edge score, difference hash and dithered colours."""
    from ..operators.images import kernel_report

    return kernel_report(table(spark, sf_dir, "embeddings"))
