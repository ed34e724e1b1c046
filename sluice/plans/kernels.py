"""Picture kernels over pictures made from the vectors table, against SQL over their pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pictures
from .registry import query, table

PIXELS = """b AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings), r AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(greatest(0, least(255, floor((e + 0.5) * 255))) AS BIGINT) AS red FROM b),
p AS (SELECT vec_id, y, x, unnest([0, 1, 2]) AS c, unnest([red, 255 - red, red // 2]) AS v FROM r)"""
#: Kernel: its settings, the SQL of the pixels (y, x, c, v) that it makes, and the width and channels of its picture.
POINTS = {
    "invert": ({}, "SELECT vec_id, y, x, c, 255 - v AS v FROM p", 8, 3),
    "offset_wrap": ({}, "SELECT vec_id, (y + 4) % 8 AS y, (x + 4) % 8 AS x, c, v FROM p", 8, 3),
    "montage": ({"down": 2, "across": 3}, "SELECT vec_id, y + 8 * t.dy AS y, x + 8 * t.dx AS x, c, v FROM p, (SELECT unnest([0, 0, 0, 1, 1, 1]) AS dy, unnest([0, 1, 2, 0, 1, 2]) AS dx) AS t", 24, 3),
    "crop": ({"box": [1, 2, 5, 7]}, "SELECT vec_id, y - 2 AS y, x - 1 AS x, c, v FROM p WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6", 4, 3),
    "flip_channel": ({"channel": 1}, "SELECT vec_id, y, x, c, CASE WHEN c = 1 THEN 255 - v ELSE v END AS v FROM p", 8, 3),
    "channel": ({"index": 2}, "SELECT vec_id, y, x, 0 AS c, v FROM p WHERE c = 2", 8, 1),
    "pack": ({"order": [2, 0, 1]}, "SELECT vec_id, y, x, (c + 1) % 3 AS c, v FROM p", 8, 3),
    "shift": ({"red": 40.0, "green": -20.0}, "SELECT vec_id, y, x, c, greatest(0, least(255, v + CASE c WHEN 0 THEN 40 WHEN 1 THEN -20 ELSE 0 END)) AS v FROM p", 8, 3),
    "checkerboard": ({"cell": 3}, "SELECT vec_id, y, x, c, CASE WHEN (y // 3 + x // 3) % 2 = 0 THEN 255 ELSE 204 END AS v FROM p", 8, 3),
    "despill": ({}, "SELECT vec_id, y, x, c, CASE WHEN c = 1 THEN least(v, max(CASE WHEN c <> 1 THEN v END) OVER (PARTITION BY vec_id, y, x)) ELSE v END AS v FROM p", 8, 3),
    "median": ({"radius": 1}, "SELECT q.vec_id, q.y, q.x, q.c, CAST(median(n.v) AS BIGINT) AS v FROM p q, (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dx) AS t, p n WHERE n.vec_id = q.vec_id AND n.c = q.c AND n.y = greatest(0, least(7, q.y + dy)) AND n.x = greatest(0, least(7, q.x + dx)) GROUP BY ALL", 8, 3),
}


@query(f"WITH {PIXELS} " + " UNION ALL ".join(f"SELECT vec_id, '{name}' AS kernel, CAST(sum(((y * {w} + x) * {n} + c + 1) * v) AS BIGINT) AS checksum FROM ({sql}) GROUP BY 1" for name, (_, sql, w, n) in POINTS.items()))
def picture_kernels(spark, sf_dir):
    """A checksum by place of what each kernel makes of each picture."""
    base = pictures.from_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    out = None
    for name, (params, *_) in POINTS.items():
        part = pictures.measure(pictures.transform(base, name, **params), ["checksum"]).select("vec_id", F.lit(name).alias("kernel"), "checksum")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {PIXELS}, e AS (SELECT vec_id, c, v FROM p WHERE y IN (0, 7) OR x IN (0, 7)), m AS (SELECT vec_id, c, CAST(floor(median(v)) AS BIGINT) AS v FROM e GROUP BY 1, 2)
SELECT vec_id, '#' || printf('%02x', max(v) FILTER (c = 0)) || printf('%02x', max(v) FILTER (c = 1)) || printf('%02x', max(v) FILTER (c = 2)) AS border,
CASE WHEN max(v) FILTER (c = 1) >= 80 AND max(v) FILTER (c = 1) > 1.4::DOUBLE * max(v) FILTER (c <> 1) THEN 'green' WHEN max(v) FILTER (c = 2) >= 80 AND max(v) FILTER (c = 2) > 1.4::DOUBLE * max(v) FILTER (c <> 2) THEN 'blue' END AS screen FROM m GROUP BY 1"""
)
def picture_borders(spark, sf_dir):
    """The median colour of each picture's border, and whether that is a screen."""
    base = pictures.from_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return pictures.measure(pictures.transform(base, "shift"), ["border", "screen"])


@query(f"WITH {PIXELS}, s AS (SELECT vec_id, avg(abs(a.v - b.v)) AS mx, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS rx FROM p a JOIN p b USING (vec_id, y, c) WHERE a.x = 0 AND b.x = 7 GROUP BY 1), t AS (SELECT vec_id, avg(abs(a.v - b.v)) AS my, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS ry FROM p a JOIN p b USING (vec_id, x, c) WHERE a.y = 0 AND b.y = 7 GROUP BY 1) SELECT vec_id, round(least(1 - (mx + rx) / 2 / 255, 1 - (my + ry) / 2 / 255), 9) AS seam, round((SELECT avg(v) FROM p WHERE p.vec_id = s.vec_id), 9) AS mean FROM s JOIN t USING (vec_id)")
def picture_seams(spark, sf_dir):
    """How well opposite edges of each picture fit, and its mean."""
    base = pictures.from_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return pictures.measure(base, ["seam_score", "mean"]).select("vec_id", F.round("seam_score", 9).alias("seam"), F.round("mean", 9).alias("mean"))


@query(
    f"""WITH {PIXELS}, g AS (SELECT vec_id, y, x, sum(v * CASE c WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END) AS v FROM p GROUP BY ALL),
w AS (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dx, unnest([1, -2, 1, -2, 4, -2, 1, -2, 1]) AS f),
k AS (SELECT a.vec_id, a.y, a.x, sum(f * n.v) AS k FROM g a, w, g n WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND n.vec_id = a.vec_id AND n.y = a.y + dy AND n.x = a.x + dx GROUP BY ALL)
SELECT vec_id, round(avg(abs(k)) * sqrt(pi() / 2) / 6, 6) AS sigma FROM k GROUP BY 1"""
)
def picture_noise(spark, sf_dir):
    """How noisy each picture is, by its second differences."""
    base = pictures.from_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return pictures.measure(base, ["noise_sigma"]).select("vec_id", F.round("noise_sigma", 6).alias("sigma"))
