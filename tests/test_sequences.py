import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from sluice import cli
from sluice.functions import enhance
from sluice.operators import pictures, sinks
from sluice.sources import pictures as sequences
from sluice.sources.files import listing

SHEET = np.zeros((64, 96, 4), np.uint8)
SHEET[4:20, 4:30] = 255
SHEET[30:50, 40:60] = 200


def test_sequence_frames_and_sheets(spark, tmp_path):
    for i in (10, 2, 1):
        (tmp_path / f"f{i}.png").write_bytes(sinks.png(np.full((8, 8, 3), i, np.uint8)))
    (tmp_path / "f3.png").write_bytes(b"x")
    (tmp_path / "empty").mkdir()
    got = sequences.sequence(spark, f"file://{tmp_path}/*.png").orderBy("frame").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["f1.png", "f2.png", "f10.png"]
    with pytest.raises(sequences.TooMuch):
        sequences.sequence(spark, f"file://{tmp_path}/*.png", most_frames=2)
    rows = listing(spark, str(tmp_path))
    assert [r.path for r in sequences.empty_folders(rows).collect()] == [f"{tmp_path}/empty"]
    assert sequences.discover(rows, str(tmp_path)).count() == 4 and sequences.identities(spark, str(tmp_path)).count() == 4
    named = spark.createDataFrame([("f1",), ("g",)], "name string")
    there = {r.name: r.shot for r in sequences.presence(named, rows, {"shot": f"{tmp_path}/{{}}.png"}).collect()}
    assert there == {"f1": True, "g": False}

    df = spark.createDataFrame([("s", sinks.png(SHEET))], "path string, png binary").select("path", F.lit(None).alias("x"))
    df = spark.createDataFrame([("s", pictures.struct_of(SHEET)), ("n", None)], f"path string, picture {pictures.PICTURE}")
    boxes = lambda **how: [r.box for r in sequences.frames(df, **how).orderBy("frame").collect()]
    assert boxes(mode="auto") == ["4,4,30,20", "40,30,60,50"] and boxes(mode="image") == ["0,0,96,64"]
    assert len(boxes(mode="grid", rows=2, columns=5)) == 10 and boxes(mode="cell", cell_height=40, cell_width=40) == ["0,0,40,40", "40,0,80,40"]
    page = sequences.sheets(pictures.read(spark, f"file://{tmp_path}/*.png"), columns=2, rows=1, cell=8, pad=0).orderBy("page").collect()
    assert [r.page for r in page] == [0, 1] and pictures.pixels(page[0].picture.asDict()).shape == (8, 16, 3)
    assert sequences.leaks(sinks.png(SHEET)) == [] and sequences.leaks(sinks.png(SHEET)[:-12] + b"\0\0\0\1tEXta\0\0\0\0") == ["tEXt"]


def test_cli(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name in "ab":
        (source / f"{name}.png").write_bytes(sinks.png(np.full((8, 8, 3), 7, np.uint8)))
    assert cli.main([f"file://{source}", f"file://{out}", "--kernel", "invert", "--limit", "1"], spark) == 0
    rows = spark.read.parquet(f"file://{out}/pictures").collect()
    assert len(rows) == 1 and rows[0].path.endswith("a.png") and rows[0].png[:4] == b"\x89PNG"
    assert json.loads((out / "_manifest.json").read_text())["counts"] == {"done": 1, "failed": 0}
    (source / "c.png").write_bytes(b"broken")
    assert cli.main([f"file://{source}", f"file://{out}", "--kernel", "crop", "--params", '{"box": [0, 0, 2, 2]}'], spark) == 1


def test_stack_merges(spark):
    steps = spark.range(1).select(enhance.merged(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(v).alias("value")) for o, v in (("contrast", 2.0), ("contrast", 3.0), ("clarity", 1.0), ("contrast", 0.5), ("gamma", 2.0), ("gamma", 2.0))])).alias("s")).first().s
    assert [(x.op, x.value) for x in steps] == [("contrast", 6.0), ("clarity", 1.0), ("contrast", 0.5), ("gamma", 2.0), ("gamma", 2.0)]
    for wrong in (lambda: enhance.stack("none"), lambda: enhance.plan("x", True, 1), lambda: enhance.plan("ai", True, 9)):
        with pytest.raises(ValueError):
            wrong()
