"""Splits, sizes, intervals, budgets and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers
from ..operators import scans, tables
from .registry import inline, query, sql_values, table


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+$') AS INTEGER), doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, rank, CASE WHEN rank < round_even(CAST(n AS DOUBLE) * 0.8, 0) THEN 'train' WHEN rank < round_even(CAST(n AS DOUBLE) * 0.8, 0) + round_even(CAST(n AS DOUBLE) * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def split_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "[0-9]+$", 0).cast("int").alias("number"), "doc_id")
    return tables.split(docs, ["number", "doc_id"]).select("doc_id", "rank", "split")


SIZES = [(512, 512), (768, 512), (512, 768), (None, None), (0, 10)]
SIDES = f"(SELECT p_size * 10 AS w, CAST(floor(p_retailprice / 5) AS INTEGER) AS h FROM part UNION ALL SELECT w, h FROM {sql_values(SIZES, 'w, h')})"


def sides(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_size") * 10).alias("w"), F.floor(F.col("p_retailprice") / 5).cast("int").alias("h"))
    return part.unionAll(inline(spark, SIZES, "w int, h int"))


@query(f"SELECT w, h, CASE WHEN coalesce(w, 0) = 0 OR coalesce(h, 0) = 0 THEN 'unknown' ELSE w || 'x' || h END AS bucket FROM {SIDES}")
def bucket_dims(spark, sf_dir):
    return sides(spark, sf_dir).select("w", "h", numbers.bucket(F.col("w"), F.col("h")).alias("bucket"))


@query(f"SELECT w, h, CASE WHEN coalesce(w, 0) = 0 OR coalesce(h, 0) = 0 THEN 'unknown' WHEN w / h::DOUBLE >= 1.05 THEN 'landscape' WHEN w / h::DOUBLE <= 0.95 THEN 'portrait' ELSE 'square' END AS bucket FROM {SIDES}")
def bucket_aspect(spark, sf_dir):
    return sides(spark, sf_dir).select("w", "h", numbers.bucket(F.col("w"), F.col("h"), "aspect").alias("bucket"))


def fit_sql(factor, snap, upscale):
    f = f"least({factor}, 8.0::DOUBLE)" if upscale else f"least(least({factor}, 8.0::DOUBLE), 1.0::DOUBLE)"
    side = lambda x: f"least(greatest(CAST(floor({x} * {f} + 0.5) AS BIGINT), 1), 16384)"
    snapped = lambda x: f"greatest(1, {side(x)} - {side(x)} % {snap})"
    return f"CAST({snapped('w')} AS INTEGER) || 'x' || CAST({snapped('h')} AS INTEGER)"


MODES = {"longest": ("longest_side", 300, 1, False), "fit": ("fit_inside", 800, 1, True), "pixels": ("max_mp", 0.02, 1, False), "factor": ("scale_factor", 0.53, 64, True)}
FACTORS = {"longest_side": "({t}::DOUBLE / greatest(w, h))", "fit_inside": "({t}::DOUBLE / greatest(w, h))", "max_mp": "least(1.0::DOUBLE, sqrt({t}::DOUBLE * 1e6 / (w * h)))", "scale_factor": "({t}::DOUBLE)"}


@query("SELECT w, h, " + ", ".join(f"{fit_sql(FACTORS[m].format(t=t), s, u)} AS {k}" for k, (m, t, s, u) in MODES.items()) + f" FROM {SIDES} WHERE w > 0 AND h > 0")
def resize_plan(spark, sf_dir):
    """The size that each of the four modes gives."""
    out = []
    for name, (mode, target, snap, up) in MODES.items():
        w, h = numbers.fit_size(F.col("w"), F.col("h"), numbers.size_factor(mode, F.col("w"), F.col("h"), target), snap, up)
        out.append(F.concat(w.cast("string"), F.lit("x"), h.cast("string")).alias(name))
    return sides(spark, sf_dir).where("w > 0 AND h > 0").select("w", "h", *out)


@query(
    """WITH t AS (SELECT user_id, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) - epoch_us(min(ts)) AS length FROM events WHERE user_id IS NOT NULL GROUP BY 1),
g AS (SELECT user_id, epoch_us(ts) - t0 AS s, epoch_us(ts) - t0 + CAST(value * 600 AS BIGINT) * 1000000 AS e FROM events JOIN t USING (user_id) WHERE event_type = 'error' AND value IS NOT NULL UNION ALL SELECT user_id, length, length FROM t),
r AS (SELECT user_id, s, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM g)
SELECT user_id, reach AS start_s, s AS end_s FROM r WHERE s - reach >= 500000"""
)
def clip_plan(spark, sf_dir):
    """What lies outside the error intervals of each user, from the first event to the last, in microseconds."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_type", "value", ts.alias("at"))
    spans = tables.save(events.groupBy("user_id").agg(F.min("at").alias("t0"), (F.max("at") - F.min("at")).alias("length")), "lengths")
    errors = events.where("event_type = 'error' AND value IS NOT NULL").join(spans, "user_id").withColumn("s", F.col("at") - F.col("t0"))
    gaps = errors.select("user_id", "s", (F.col("s") + F.round(F.col("value") * 600).cast("long") * 1000000).alias("e"))
    return scans.content_between(gaps, spans.select("user_id", "length"), "user_id", "s", "e", "length", 500000)


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events"""
)
def latest_high_value(spark, sf_dir):
    """The last value of 50 or more that a user had before each event."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    high = F.when(F.col("value") >= 50, F.col("value"))
    return scans.prefix_scan(events, ["user_id"], ["ts", "event_id"], high, "last", "latest").select("event_id", "user_id", "latest")


@query(
    """WITH d AS (SELECT event_id, event_type, ts, CAST(round(coalesce(value, 0) * 100) AS BIGINT) - 4000 AS d FROM events),
s AS (SELECT event_id, event_type, ts, sum(d) OVER w AS s FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, event_type, CAST(s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS balance FROM s"""
)
def balance_above_zero(spark, sf_dir):
    """A balance of each type of event in hundredths, 40 less at each one, that never falls below 0. Steps are functions
    x -> greatest(low, x + add), whose compositions are of this kind again."""
    add = (F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") - 4000).alias("add")
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", add)

    def then(f, g):
        return F.struct((f["add"] + g["add"]).alias("add"), F.greatest(g["low"], f["low"] + g["add"]).alias("low"))

    step = F.struct("add", F.lit(0).cast("long").alias("low"))
    done = scans.prefix_scan(events, ["event_type"], ["ts", "event_id"], step, then, "f", inclusive=True)
    return done.select("event_id", "event_type", F.greatest("f.low", "f.add").alias("balance"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM lineitem),
c AS (SELECT *, min(CASE WHEN used > 150 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop FROM r)
SELECT l_orderkey, count(*) AS items, sum(CASE WHEN stop IS NULL OR l_linenumber < stop THEN 1 ELSE 0 END)::BIGINT AS written, max(stop) AS aborted_at FROM c GROUP BY 1"""
)
def budget_cutoff(spark, sf_dir):
    """Items are taken in order until their running quantity passes 150; the first that does ends the order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("used"))
    stop = F.min(F.when(F.col("used") > 150, F.col("l_linenumber"))).over(Window.partitionBy("l_orderkey"))
    rows = rows.withColumn("stop", stop)
    written = F.count_if(F.col("stop").isNull() | (F.col("l_linenumber") < F.col("stop")))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("items"), written.alias("written"), F.max("stop").alias("aborted_at"))


STATUS = "CASE WHEN l_quantity > 45 THEN 'rejected' WHEN l_returnflag = 'R' THEN 'skipped' WHEN l_linestatus = 'O' THEN 'listed' ELSE 'written' END"


@query(f"SELECT {STATUS} AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS bytes FROM lineitem GROUP BY 1")
def member_status(spark, sf_dir):
    """The first rule that applies gives a member's status."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_quantity") > 45, "rejected").when(F.col("l_returnflag") == "R", "skipped").when(F.col("l_linestatus") == "O", "listed").otherwise("written")
    return lines.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("bytes"))


BPP = "(l_extendedprice / (l_quantity * 20000))"
SAVING = f"round(least(0.85::DOUBLE, greatest(0.0::DOUBLE, 1 - 0.07::DOUBLE / {BPP}) * 0.9::DOUBLE + CASE WHEN l_returnflag = 'A' THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END), 3)"


@query(f"SELECT CASE WHEN l_returnflag = 'A' AND {BPP} <= 0.07 THEN 'skip_efficient' WHEN {SAVING} < 0.15 THEN 'skip_saving' ELSE 'compress' END AS decision, count(*) AS n, round(avg({SAVING}), 6) AS saving FROM lineitem GROUP BY 1")
def compress_decision(spark, sf_dir):
    """Skip what is compact already or would save under 15 %."""
    bpp = F.col("l_extendedprice") / (F.col("l_quantity") * 20000)
    saving = numbers.expected_saving(bpp, F.lit(0.07), F.col("l_returnflag") == "A")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", bpp.alias("bpp"), saving.alias("saving"))
    decision = F.when((F.col("l_returnflag") == "A") & (F.col("bpp") <= 0.07), "skip_efficient").when(F.col("saving") < 0.15, "skip_saving").otherwise("compress")
    return rows.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg("saving"), 6).alias("saving"))


@query(
    """WITH a AS (SELECT page_id, url, length(html) AS size FROM pages), b AS (SELECT *, CASE WHEN size > 4000 THEN 'too_large' WHEN starts_with(url, 'http:') THEN 'insecure' END AS e1 FROM a),
c AS (SELECT *, CASE WHEN e1 IS NULL AND contains(url, '?') THEN 'has_query' END AS e2 FROM b)
SELECT coalesce(e1, e2, 'ok') AS outcome, CASE WHEN e1 IS NOT NULL THEN 1 WHEN e2 IS NOT NULL THEN 2 ELSE 3 END AS stage, count(*) AS n FROM c GROUP BY 1, 2"""
)
def stage_pipeline(spark, sf_dir):
    """Three stages; a row that fails one is not tried by the next but keeps its outcome."""
    rows = table(spark, sf_dir, "pages").select("url", F.length("html").alias("size"), F.lit(None).cast("string").alias("outcome"), F.lit(3).alias("stage"))
    rules = [F.when(F.col("size") > 4000, "too_large").when(F.col("url").startswith("http:"), "insecure"), F.when(F.col("url").contains("?"), "has_query")]
    for i, rule in enumerate(rules, 1):
        found = F.when(F.col("outcome").isNull(), rule)
        rows = rows.select("url", "size", F.coalesce("outcome", found).alias("outcome"), F.when(found.isNotNull(), i).otherwise(F.col("stage")).alias("stage"))
    return rows.groupBy(F.coalesce("outcome", F.lit("ok")).alias("outcome"), "stage").agg(F.count("*").alias("n"))
