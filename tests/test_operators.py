import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sluice.functions import names, numbers
from sluice.operators import images, similar, tables


def one(spark, column, *rows, schema):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_names(spark):
    unsafe = one(spark, names.is_unsafe_name(F.col("x")), ("CON",), ("CON.png",), ("a<b.png",), ("trailing.png ",), ("dotend.",), ("normal_asset.png",), ("CONSTANTS.png",), (None,), schema="x string")
    assert unsafe == [True] * 5 + [False, False, None]
    assert one(spark, names.extensions(F.col("x")), ("PNG, .jpg txt,png",), ("",), schema="x string") == [[".jpg", ".png", ".txt"], []]
    order = [r[0] for r in spark.createDataFrame([("img10",), ("img2",), ("img1",), ("img",)], "x string").orderBy(names.natural_key(F.col("x"))).collect()]
    assert order == ["img", "img1", "img2", "img10"]
    assert one(spark, names.stem(F.col("x")), ("a/b.c.png",), (".hidden",), ("a/none",), schema="x string") == ["b.c", ".hidden", "none"]


def test_replacement(spark):
    text = F.col("x")
    assert one(spark, names.replace_text(text, "cat", "dog"), ("a cat, a cat",), schema="x string") == ["a dog, a dog"]
    assert one(spark, names.count_matches(text, "cat"), ("a cat, a cat",), schema="x string") == [2]
    assert one(spark, names.replace_text(text, r"frame_\d+", "F", True), ("frame_001 frame_002",), schema="x string") == ["F F"]
    assert one(spark, names.replace_text(text, r"(\w)-(\w)", r"\2$\1", True), ("é-b",), schema="x string") == ["b$é"]
    assert one(spark, names.replace_text(text, "", "y"), ("as is",), schema="x string") == ["as is"]


def test_sizes(spark):
    def size(mode, w, h, target, **k):
        fit = numbers.fit_size(F.col("w"), F.col("h"), numbers.size_factor(mode, F.col("w"), F.col("h"), target), **k)
        return tuple(spark.createDataFrame([(w, h)], "w int, h int").select(*fit).first())

    assert size("longest_side", 2000, 1000, 1000) == (1000, 500)
    assert size("scale_factor", 2000, 1000, 0.5) == (1000, 500)
    assert size("fit_inside", 2000, 1000, 800) == (800, 400)
    assert size("longest_side", 500, 500, 2000) == (500, 500)
    assert size("longest_side", 500, 500, 2000, upscale=True) == (2000, 2000)
    assert size("scale_factor", 1000, 1000, 0.53, snap=64) == (512, 512)


def test_times(spark):
    assert one(spark, numbers.format_duration(F.col("x")), (592.0,), (3661.0,), (0.0,), (None,), schema="x double") == ["9:52", "1:01:01", "--:--", "--:--"]
    assert one(spark, numbers.parse_time(F.col("x")), ("1:30",), ("1:0:0",), ("",), ("x",), schema="x string") == [90.0, 3600.0, None, None]
    assert one(spark, numbers.bucket(F.col("w"), F.col("h")), (512, 512), (None, 2), schema="w int, h int") == ["512x512", "unknown"]


def test_split_is_half_even(spark):
    rows = spark.createDataFrame([(f"img{i:02}.png",) for i in range(10)], "name string")
    got = [r.split for r in tables.split(rows, ["name"]).orderBy("rank").collect()]
    assert got == ["train"] * 8 + ["val", "test"]


def test_pairing(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "stem string, image int")
    right = spark.createDataFrame([("a", 7), ("b", 8), ("z", 9)], "stem string, caption int")
    got = {r.stem: r.status for r in tables.pair(left, right, "stem", "image", "caption").collect()}
    assert got == {"a": "pair", "b": "pair", "c": "missing", "z": "orphan"}
    twice = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert sorted(map(tuple, tables.first_per(twice, ["k"], ["o"]).collect())) == [("a", 1, "y"), ("b", 5, None)]
    assert tables.differing(left, left).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2, 8, 63])
def test_hamming_pairs_and_components(spark, most):
    rng = random.Random(20260722)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [values[0], values[1] ^ 1, values[1] ^ 3, values[2] ^ 0xFF]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    got = {(r.a, r.b): r.distance for r in similar.hamming_pairs(df, "id", "h", most).collect()}
    first = {v: values.index(v) for v in values}
    want = {(i, j): d for j, y in enumerate(values) for i, x in enumerate(values[:j]) if first[x] == i and first[y] == j and 0 < (d := (x ^ y).bit_count()) <= most}
    assert got == want
    assert {r.id: r["first"] for r in similar.representatives(df, "id", "h").collect()} == {i: first[v] for i, v in enumerate(values)}
    up = {i: i for i in range(len(values))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in want:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    ends = {x for p in want for x in p}
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert {r.id: r.label for r in similar.components(pairs).collect()} == {i: find(i) for i in ends}


def test_kernels():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 255, (64, 64, 3), dtype=np.uint8)
    near, far = base.copy(), np.roll(base, 32, 1)
    near[3, 4], near[20, 20] = 0, 255
    count = lambda a, b: sum(x != y for x, y in zip(images.difference_hash(a), images.difference_hash(b), strict=True))
    assert count(base, near) <= 8 < count(base, far)
    flat = np.full((32, 32, 3), 90, np.uint8)
    assert images.seam_scores(flat)[2] > 0.99
    seam = flat.copy()
    seam[:, 0], seam[:, -1] = 0, 255
    x, y, _ = images.seam_scores(seam)
    assert x < 0.2 and y > 0.99
    assert (images.offset_wrap(images.offset_wrap(base)) == base).all()
    mask = np.zeros((10, 20), bool)
    mask[1:3, 1:4] = mask[5:8, 10:15] = True
    mask[9, 19] = True
    assert images.boxes(mask, 2) == [(1, 1, 4, 3), (10, 5, 15, 8)]
    assert set(np.unique(images.diffuse(base))) <= {0, 255}
    noisy = np.clip(128 + rng.normal(0, 12, (128, 128)), 0, 255)
    assert 9 < images.noise_sigma(noisy) < 15
    assert images.resize(base, 64, 64).round().astype(np.uint8).tolist() == base.tolist()
    assert images.white_balance(flat).std() < 1e-6
