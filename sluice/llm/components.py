"""Connected components by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SALTS = 8


def nearest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the least neighbour m of u. A hub's edges are dealt over SALTS tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(least, ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) for every end of the links (a, b): the least doc_id of its component. Loops and repeats are harmless."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionAll(edges.selectExpr("v AS u", "u AS v"))
        large = nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = nearest(large)
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v"))).distinct()
        edges = save(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("label")).unionAll(edges.select("v", "v")).distinct()


def roots(parents: DataFrame) -> DataFrame:
    """(doc_id, label) from a forest (a, b) whose parents b are less than their children a: each child's root, and each
    root itself. Every round halves the paths."""
    now = save(parents.groupBy("a").agg(F.min("b").alias("b")), "parents")
    while True:
        above = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = save(now.join(above, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "roots")
        now = new.select("a", "b")
        if new.where("moved").isEmpty():
            return now.select(F.col("a").alias("doc_id"), F.col("b").alias("label")).unionAll(now.select("b", "b").distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the components that the links (a, b) connect made one; ends without a label are their own."""
    named = links
    for end in ("a", "b"):
        to = labels.withColumnsRenamed({"doc_id": end, "label": f"{end}_label"})
        named = named.join(to, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    between = save(named.where("a_label != b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    top = components(between)
    moved = labels.join(top.select(F.col("doc_id").alias("label"), F.col("label").alias("top")), "label", "left")
    moved = moved.select("doc_id", F.coalesce("top", "label").alias("label"))
    return save(moved.unionAll(top.join(labels, "doc_id", "left_anti").select("doc_id", "label")), "labels")
