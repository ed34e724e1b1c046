"""Grids, edges, colours and palettes over numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import tables
from .registry import query, table


@query("SELECT p_partkey, CAST(i // 24 AS BIGINT) AS page, CAST(i % 24 // 6 AS BIGINT) AS row, CAST(i % 6 AS BIGINT) AS col FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)")
def grid_layout(spark, sf_dir):
    """Pages of 4 rows and 6 columns."""
    ranked = tables.global_rank(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "i")
    return ranked.select("p_partkey", F.expr("i div 24").alias("page"), F.expr("(i % 24) div 6").alias("row"), F.expr("i % 6").alias("col"))


BOX = "CAST(c * cw AS INTEGER) AS l, CAST(r * ch AS INTEGER) AS t, CAST((c + 1) * cw AS INTEGER) AS right_, CAST((r + 1) * ch AS INTEGER) AS bottom"


@query(f"WITH p AS (SELECT p_partkey, p_size * 7 // 3 AS cw, p_size * 5 // 2 AS ch FROM part), g AS (SELECT *, unnest(range(2)) AS r FROM p), h AS (SELECT *, unnest(range(3)) AS c FROM g) SELECT p_partkey, {BOX} FROM h WHERE cw > 0 AND ch > 0")
def grid_boxes(spark, sf_dir):
    """Boxes of 2 rows and 3 columns of a sheet; sizes are rounded down and what is left over stays out."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_size * 7 div 3").alias("cw"), F.expr("p_size * 5 div 2").alias("ch"))
    cells = parts.where("cw > 0 AND ch > 0").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return cells.selectExpr("p_partkey", "int(c * cw) AS l", "int(r * ch) AS t", "int((c + 1) * cw) AS right_", "int((r + 1) * ch) AS bottom")


@query(f"WITH p AS (SELECT p_partkey, p_size * 7 AS w, p_size * 5 AS h, 32 AS cw, 24 AS ch FROM part), g AS (SELECT *, unnest(range(h // ch)) AS r FROM p), k AS (SELECT *, unnest(range(w // cw)) AS c FROM g) SELECT p_partkey, {BOX} FROM k")
def cell_boxes(spark, sf_dir):
    """Boxes of a fixed size; cells that would be cut stay out."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 7 AS w", "p_size * 5 AS h", "32 AS cw", "24 AS ch").where("w >= cw AND h >= ch")
    cells = parts.withColumn("r", F.explode(F.expr("sequence(0, int(h div ch) - 1)"))).withColumn("c", F.explode(F.expr("sequence(0, int(w div cw) - 1)")))
    return cells.selectExpr("p_partkey", "int(c * cw) AS l", "int(r * ch) AS t", "int((c + 1) * cw) AS right_", "int((r + 1) * ch) AS bottom")


DIFFS = "list_transform(range(1, 33), lambda i: abs(embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE))"


@query(f"SELECT vec_id, round(greatest(0.0, least(1.0, 1 - (list_avg(d) + sqrt(list_avg(list_transform(d, lambda x: x * x)))) / 2 / 1.0)), 6) AS score FROM (SELECT vec_id, {DIFFS} AS d FROM embeddings)")
def seam_score(spark, sf_dir):
    """How well the two halves of a vector fit, as of opposite edges."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(numbers.seam_score(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), 1.0), 6).alias("score"))


RGB = "SELECT vec_id, " + ", ".join(f"least(255, greatest(0, CAST(floor((embedding[{i}]::DOUBLE + 0.5) * 255) AS INTEGER))) AS {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM embeddings"


def colours(spark, sf_dir):
    part = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("embedding")[i].cast("double") + 0.5) * 255).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


@query(f"SELECT vec_id, CAST(trunc(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sqrt((r*r + (g-255)*(g-255) + b*b)::DOUBLE) - 100) / 60)) * 255) AS INTEGER) AS alpha, least(g, greatest(r, b)) AS green, CASE WHEN 0.299*r + 0.587*g + 0.114*b > 140 THEN 'dark' ELSE 'light' END AS ink FROM ({RGB})")
def chroma_alpha(spark, sf_dir):
    """Opacity against a green screen, the green left over, and the ink that can be read on the colour."""
    r, g, b = map(F.col, "rgb")
    ink = F.when(numbers.luminance(r, g, b) > 140, "dark").otherwise("light")
    return colours(spark, sf_dir).select("vec_id", numbers.chroma_alpha(r, g, b, (0, 255, 0)).alias("alpha"), numbers.despill(r, g, b).alias("green"), ink.alias("ink"))


# A palette of eight colours.
PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (128, 128, 128), (192, 128, 64)]
NEAREST = "[" + ", ".join(f"((r-{p[0]})*(r-{p[0]}) + (g-{p[1]})*(g-{p[1]}) + (b-{p[2]})*(b-{p[2]}))" for p in PALETTE) + "]"


def nearest(r, g, b):
    """Index of the nearest palette colour, the first of equal ones."""
    d = F.array(*[(r - p[0]) * (r - p[0]) + (g - p[1]) * (g - p[1]) + (b - p[2]) * (b - p[2]) for p in PALETTE])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


@query(f"SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS colour FROM (SELECT vec_id, {NEAREST} AS d FROM ({RGB}))")
def nearest_palette(spark, sf_dir):
    return colours(spark, sf_dir).select("vec_id", nearest(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


def bayer(n: int) -> list[int]:
    """Threshold matrix of order n (a power of two), row by row, made by the doubling rule."""
    m = [[0]]
    while len(m) < n:
        k = len(m)
        m = [[4 * m[y % k][x % k] + ((0, 2), (3, 1))[y // k][x // k] for x in range(2 * k)] for y in range(2 * k)]
    return [x for row in m for x in row]


MATRIX = bayer(4)


@query(
    f"""WITH t AS (SELECT vec_id, r, g, b, {MATRIX}[CAST(vec_id % 4 * 4 + vec_id // 4 % 4 AS INTEGER) + 1] AS m FROM ({RGB})),
s AS (SELECT vec_id, {', '.join(f'least(255, greatest(0, {c} + 4 * m - 30)) AS {c}' for c in 'rgb')} FROM t)
SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS colour FROM (SELECT vec_id, {NEAREST} AS d FROM s)"""
)
def bayer_dither(spark, sf_dir):
    """A threshold by position is added before the nearest colour is taken."""
    place = (F.col("vec_id") % 4 * 4 + F.floor(F.col("vec_id") / 4) % 4).cast("int")
    m = F.get(F.array(*map(F.lit, MATRIX)), place)
    shifted = [F.least(F.lit(255), F.greatest(F.lit(0), F.col(c) + m * 4 - 30)) for c in "rgb"]
    return colours(spark, sf_dir).select("vec_id", nearest(*shifted).alias("colour"))
