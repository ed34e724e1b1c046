"""Prefix scans of any associative operation, along an order and within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import save

Combine = Callable[[Column, Column], Column]

#: Operations that Spark has as window functions; the others are doubled, see prefix_scan(). Nulls add nothing to any.
BUILT_IN: dict[str, tuple[Combine, Callable[[Column], Column]]] = {
    "sum": (lambda a, b: a + b, F.sum),
    "max": (lambda a, b: F.greatest(a, b), F.max),
    "min": (lambda a, b: F.least(a, b), F.min),
    "last": (lambda a, b: b, lambda c: F.last(c, ignorenulls=True)),
    "first": (lambda a, b: a, lambda c: F.first(c, ignorenulls=True)),
}


def either(combine: Combine) -> Combine:
    """combine with null as what changes nothing."""
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))


def up_to_here(rows: DataFrame, w: WindowSpec, combine: Combine, built_in, longest: int) -> DataFrame:
    """rows with _v replaced by what the values up to and with each row of its window combine to. An operation that is no
    window function is applied over distances that double: `longest` is a bound on the rows of a window."""
    if built_in:
        return rows.withColumn("_v", built_in(F.col("_v")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reach = 1
    while reach < longest:
        rows = rows.withColumn("_far", F.lag("_v", reach).over(w)).withColumn("_v", combine(F.col("_far"), F.col("_v"))).drop("_far")
        reach *= 2
    return rows


def prefix_scan(df: DataFrame, by: list[str], order: list[str], value: Column, operation: str | Combine, name: str, inclusive: bool = False) -> DataFrame:
    """df with `name`: what the values of all rows before each (with inclusive: and of the row itself) combine to, among the
    rows that agree in `by`, along `order`; null where there are none.

    operation is sum, max, min, last or first (of values that are not null), or any associative function of two Columns,
    earlier ones first; values may be structs. Null values add nothing. Ties are ordered by all other columns; rows that agree
    in every column stay rows. Null keys form a group.

    No task holds a group: rows are dealt by ranges of (by, order), scanned within each range side by side, and each range
    adds what its first group has in the ranges before it. Of ranges only the first and the last group can go on in others,
    so that two rows a range are broadcast, however many groups there are.
    """
    spark = df.sparkSession
    combine, built_in = BUILT_IN[operation] if isinstance(operation, str) else (operation, None)
    combine = either(combine)
    rest = [c for c in df.columns if c not in by and c not in order]
    group = F.struct(*by) if by else F.struct(F.lit(0))
    dealt = df.withColumn("_v", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order, *rest)
    dealt = save(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_group", group), "ranges")
    w = Window.partitionBy("_part", "_group").orderBy(*order, *rest)
    parts = dealt.groupBy("_part").agg(F.min("_group").alias("_least"), F.max("_group").alias("_most"), F.count("*").alias("_n"))
    parts = save(parts, "parts")  # a row a range
    longest = parts.agg(F.max("_n")).first()[0] or 1
    local = up_to_here(dealt, w, combine, built_in, longest)
    local = local.withColumn("_before", F.lag("_v").over(w)).withColumn("_end", F.lead(F.lit(True)).over(w).isNull())
    local = save(local, "scanned")

    edges = local.where("_end").join(F.broadcast(parts), "_part").where("_group = _least OR _group = _most").select("_part", "_group", "_v")
    along = Window.partitionBy("_group").orderBy("_part")
    totals = up_to_here(edges, along, combine, built_in, parts.count())
    carry = totals.select("_part", "_group", F.lag("_v").over(along).alias("_carry")).where("_carry IS NOT NULL")
    near = F.col("_v") if inclusive else F.col("_before")
    return local.join(F.broadcast(save(carry, "carry")), ["_part", "_group"], "left").select(*df.columns, combine(F.col("_carry"), near).alias(name))


def content_between(gaps: DataFrame, lengths: DataFrame, by: str, start: str, end: str, length: str, least: float) -> DataFrame:
    """(by, start_s, end_s): the stretches of at least `least` outside the intervals (start, end) of each, from 0 to its
    length, the first and the last one as well; one without intervals is a single stretch.

    Intervals may overlap or repeat, and begin or end outside. Those with a null bound are left out, as are intervals of
    what `lengths` (one row each) does not name.
    """
    named = gaps.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(by, start, end).join(lengths.select(by), by, "left_semi")
    zero = F.lit(0).cast(gaps.schema[start].dataType)
    reached = prefix_scan(named, [by], [start, end], F.col(end), "max", "_reach")
    cursor = F.greatest(F.coalesce("_reach", zero), zero)
    inner = reached.select(by, cursor.alias("start_s"), F.col(start).alias("end_s"))
    far = named.groupBy(by).agg(F.max(end).alias("_far"))
    tail = lengths.join(far, by, "left").select(by, F.greatest(F.coalesce("_far", zero), zero).alias("start_s"), F.col(length).alias("end_s"))
    return inner.unionByName(tail).where(F.col("end_s") - F.col("start_s") >= least)
