"""Joins, groups, windows and set operations over listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder that spark.checkpoint.dir names; in a local one where it is unset, for a local master."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/sluice-{label}-{uuid.uuid4().hex}"


#: Tables that this driver's operators have saved and not yet cleared.
SAVED: list[str] = []


def save(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder; see new_path()."""
    path = new_path(df.sparkSession, label)
    SAVED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables that operators have saved so far; only for results that are written or no longer wanted."""
    n = 0
    while SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(SAVED.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def duplicate_groups(df: DataFrame, key: Column, member: Column) -> DataFrame:
    """(digest, member, first, n): a row for each member of keys with two or more, with the least member and how many there
    are; null keys make no group. No group is ever held in one row."""
    keyed = df.select(key.alias("digest"), member.alias("member")).where("digest IS NOT NULL")
    groups = keyed.groupBy("digest").agg(F.min("member").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "digest").select("digest", "member", "first", "n")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order, by one aggregation rather than a sorted window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = F.min(F.struct(*order, *rest)).alias("top")
    return df.groupBy(*keys).agg(top).select(*keys, "top.*").select(*df.columns)


def pair(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Full pairing report: status pair, missing (left without right) or orphan (right without left)."""
    both = left.select(key, left_id).join(right.select(key, right_id), key, "full_outer")
    status = F.when(F.col(left_id).isNull(), "orphan").when(F.col(right_id).isNull(), "missing").otherwise("pair")
    return both.select(key, left_id, right_id, status.alias("status"))


def collisions(df: DataFrame, out: Column, source: Column) -> DataFrame:
    """(out, source, n): the sources of outputs that two or more of them would write, each once."""
    each = df.select(out.alias("out"), source.alias("source")).distinct()
    shared = each.groupBy("out").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(shared, "out").select("out", "source", "n")


def global_before(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the sum of the amounts of all rows before each in this order, without one task holding all rows: ranges are
    summed side by side, and each adds what lies before it. Ties are ordered, and dealt, by all columns."""
    spark = df.sparkSession
    full = [*order, *[c for c in df.columns if c not in order]]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *full).withColumn("_part", F.spark_partition_id())
    ranged = save(ranged.withColumn("_amount", amount.cast("long")), "ranges")
    sizes = ranged.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    before = sizes.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row a range
    local = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*full).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_amount")
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers from 0 in this order; see global_before()."""
    return global_before(df, order, F.lit(1), name)


def rank_within(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers from 0 in this order within each group, and the group's size in `size`; a group may be of any size."""
    ranked = save(global_rank(df, [*by, *order], "_rank"), "ranked")
    first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"), F.count("*").alias("size"))
    return ranked.join(first, by).select(*df.columns, (F.col("_rank") - F.col("_first")).alias(name), "size")


def split_bounds(n: Column, ratios: tuple[float, float, float]) -> tuple[Column, Column]:
    """Upper ranks of train and validation: cumulated shares of n, rounded half to even."""
    return F.bround(n * ratios[0]), F.least(n, F.bround(n * ratios[0]) + F.bround(n * ratios[1]))


def split(df: DataFrame, order: list[str], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """df with `rank` and `split` (train, val, test) along this order."""
    ranked = global_rank(df, order)
    total = ranked.agg(F.count("*").alias("_n"))
    train, val = split_bounds(F.col("_n"), ratios)
    name = F.when(F.col("rank") < train, "train").when(F.col("rank") < val, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).select(*df.columns, "rank", name.alias("split"))


def islands(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """df with `island`, a number that grows by one wherever the value changes along the order."""
    w = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, with their side; empty if both hold the same rows equally often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
