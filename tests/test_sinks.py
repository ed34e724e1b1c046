import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from sluice.operators import sinks
from sluice.sources import archives


def test_tables_and_marker(spark, tmp_path):
    out = f"file://{tmp_path}/report"
    pairs = spark.createDataFrame([("a.png", "a.txt"), ("b.png", None), (None, "c.txt")], "left string, right string")
    rows, counts = sinks.pair_tables(pairs)
    assert counts == {"paired": 1, "missing_caption": 1, "orphan_caption": 1}
    schemas = {"pairs": "file string, status string, counterpart string"}
    assert sinks.manifest_problem(spark, out, schemas) == "missing"
    for _ in range(2):  # a second report takes the place of the first
        manifest = sinks.write_tables(spark, out, {"pairs": rows}, counts)
    assert manifest["tables"]["pairs"]["rows"] == 3 and sinks.manifest_problem(spark, out, schemas) is None
    assert sorted(p.name for p in (tmp_path / "report").iterdir() if not p.name.endswith(".crc")) == ["_manifest.json", "pairs.csv", "pairs.json"]
    spark.createDataFrame([("x", "y", "z")], schemas["pairs"]).write.mode("append").json(f"{out}/pairs.json")
    assert sinks.manifest_problem(spark, out, schemas) == "changed: pairs"
    (tmp_path / "report" / "_manifest.json").unlink()
    assert sinks.manifest_problem(spark, out, schemas) == "unfinished"


def test_json_state_and_sweep(spark, tmp_path):
    path = f"file://{tmp_path}/state/s.json"
    assert sinks.read_json(spark, path, {}) == {}
    sinks.write_json(spark, path, {"b": 1, "a": [1, 2]})
    assert json.loads((tmp_path / "state" / "s.json").read_text()) == {"a": [1, 2], "b": 1}
    with pytest.raises(ValueError):
        sinks.canonical({"x": float("inf")})
    (tmp_path / "state" / "x.part").write_text("")
    (tmp_path / "state" / "y.part.png").write_text("")
    assert sinks.sweep_parts(spark, f"file://{tmp_path}/state") == 2
    sent = []
    state = sinks.decide({}, "k", "redo", lambda key: sent.append(key) or "there")
    state = sinks.decide(state, "k", "redo", lambda key: sent.append(key) or "elsewhere")
    assert sent == ["k"] and state == {"decisions": {"k": {"decision": "redo", "dest": "there"}}, "position": "k"}
    assert sinks.complete(spark, {"n": 1}, sinks.completion_path(f"file://{tmp_path}/o", "s", "t", "j"), lambda: 1 / 0) == ["manifest write failed: division by zero"]
    assert (tmp_path / "o" / "reports" / "t_j.json").exists()


def test_publish_is_all_or_nothing(spark, tmp_path):
    for name in ("new1", "old1"):
        (tmp_path / name).write_text(name)
    places = {f"file://{tmp_path}/new1": f"file://{tmp_path}/old1", f"file://{tmp_path}/absent": f"file://{tmp_path}/old2"}
    with pytest.raises(Exception):  # noqa: B017  whatever the file system raises
        sinks.publish(spark, places)
    assert (tmp_path / "old1").read_text() == "old1" and not (tmp_path / "old2").exists()


def test_copies(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    moves = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/out/a", 3), (f"{tmp_path}/a", f"{tmp_path}/out/b", 4), (f"{tmp_path}/no", f"{tmp_path}/out/c", None)], "source string, target string, bytes long")
    got = {r.target.rpartition("/")[2]: r for r in sinks.copy_files(moves).collect()}
    assert got["a"].error is None and got["a"].bytes == 3 and got["b"].error and got["c"].error
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a"]
    files = spark.createDataFrame([(f"{tmp_path}/a", 3)], "path string, bytes long")
    assert sinks.send_set(files, "o", "s").first().target == "o/a"
    assert sinks.roll_back(spark, f"file://{tmp_path}/out", [f"file://{tmp_path}/out/a", f"file://{tmp_path}/a"]) == 1 and (tmp_path / "a").exists()


def unpng(data):
    at, found = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(name + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if name == b"IDAT":
            found += body
        at += 12 + n
    return zlib.decompress(found)


def test_pictures():
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    rows = np.frombuffer(unpng(sinks.png(image)), np.uint8).reshape(5, -1)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(5, 7, 3) == image).all()
    assert sinks.data_uri(np.zeros((500, 200), np.uint8)).startswith("data:image/png;base64,")
    moving = sinks.gif([image, image[::-1]], 10)
    assert moving[:6] == b"GIF89a" and moving[-1:] == b";" and moving.count(b"!\xf9\x04") == 2
    text = sinks.page("<T>", {"a": 1}, [{"x": "<b>"}], {"p": image})
    assert "&lt;T&gt;" in text and "&lt;b&gt;" in text and "data:image/png" in text


def test_archives(spark, tmp_path):
    def zipped(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, d in files:
                z.writestr(n, d)
        return out.getvalue()

    inner = zipped([("deep.txt", b"deep")])
    outer = zipped([("a/b.txt", b"1"), ("A/B.TXT", b"2"), ("../x", b"3"), ("c:/y", b"4"), ("con.txt", b"5"), ("in.zip", inner), ("bad.zip", b"no")])
    df = spark.createDataFrame([("o.zip", outer), ("broken.zip", b"PK"), ("none.bin", b""), ("null.zip", None)], "path string, content binary")
    rows = archives.extract(df).collect()
    got = {(r.archive, r.name): r.status for r in rows if r.archive == "o.zip"}
    assert got == {
        ("o.zip", "a/b.txt"): "written", ("o.zip", "A/B_2.TXT"): "written", ("o.zip", "../x"): "rejected", ("o.zip", "c:/y"): "rejected", ("o.zip", "_con.txt"): "written",
        ("o.zip", "in.zip"): "written", ("o.zip", "in.zip/deep.txt"): "written", ("o.zip", "bad.zip"): "written", ("o.zip", "bad.zip/"): "error",
    }
    assert [r.status for r in rows if r.archive != "o.zip"] == ["error"] * 3
    for limits, why in ((archives.Limits(total=3), "bytes"), (archives.Limits(members=2), "members"), (archives.Limits(member=0), "declares")):
        last = archives.extract(df.where("path = 'o.zip'"), limits).collect()[-1]
        assert last.status == "aborted" and why in last.reason
    flat = archives.extract(df.where("path = 'o.zip'"), archives.Limits(depth=0, suffixes=(".txt",)), with_content=True).collect()
    assert {r.name: r.content for r in flat if r.status == "written"} == {"a/b.txt": b"1", "A/B_2.TXT": b"2", "_con.txt": b"5"}
    table, summary = sinks.extraction_tables(archives.extract(df))
    assert summary["action"] == "extracted" and summary["rejected"] == 2 and table.count() == len(rows)
