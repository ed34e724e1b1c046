"""Proofs of content: what is read again, which block was changed, and which subtrees agree."""

import hashlib
import os
import random

from sluice.operators import proofs
from sluice.sources.files import listing


def state(spark, top, before=None, block=1000):
    return proofs.prove(listing(spark, str(top)), before, block)


def test_only_what_may_have_changed_is_read(spark, tmp_path):
    rng = random.Random(1)
    top = tmp_path / "data"
    contents = {f"g{i % 4}/h{i % 2}/f{i}": rng.randbytes(rng.randrange(9000)) for i in range(40)} | {"g0/empty": b"", "top": b"x" * 2000}
    for name, data in contents.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    first = state(spark, top)
    rows = {r.path.removeprefix(f"{top}/"): r for r in first.collect()}
    for name, data in contents.items():
        blocks = [hashlib.sha256(data[i : i + 1000]).digest() for i in range(0, max(1, len(data)), 1000)]
        assert [bytes(b) for b in rows[name].blocks] == blocks and bytes(rows[name].sha256) == hashlib.sha256(b"".join(blocks)).digest() and rows[name].fresh
    again = state(spark, top, first)
    assert again.where("fresh").count() == 0 and proofs.differences(first, again).count() == 0
    big = max(contents, key=lambda n: len(contents[n]))
    bad = bytearray(contents[big])
    bad[3456] ^= 1
    (top / big).write_bytes(bytes(bad))
    (top / "g1/h1/new").write_bytes(b"new")
    (top / "top").unlink()
    second = state(spark, top, first)
    assert {r.path.removeprefix(f"{top}/") for r in second.where("fresh").collect()} == {big, "g1/h1/new"}  # two files of 43
    found = {r.path.removeprefix(f"{top}/"): (r.state, r.block) for r in proofs.differences(first, second).collect()}
    assert found == {big: ("changed", 3), "g1/h1/new": ("new", None), "top": ("gone", None)}
    one, two = proofs.tree(first, str(top)), proofs.tree(second, str(top))
    touched = {big.split("/")[0], "g1"}
    for g in ("g0", "g1", "g2", "g3"):
        assert proofs.same_below(one, two, f"{top}/{g}") == (g not in touched)
    assert not proofs.same_below(one, two, str(top)) and proofs.same_below(one, proofs.tree(again, str(top)), str(top))
    assert one.where("depth = 0").count() == 1 and not proofs.same_below(one, two, f"{top}/nowhere")


def test_a_change_that_keeps_size_and_time_needs_a_full_proof(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a" * 5000)
    first = state(spark, tmp_path)
    stat = os.stat(tmp_path / "f")
    (tmp_path / "f").write_bytes(b"a" * 4000 + b"b" * 1000)
    os.utime(tmp_path / "f", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert proofs.differences(first, state(spark, tmp_path, first)).count() == 0
    assert [(r.state, r.block) for r in proofs.differences(first, state(spark, tmp_path)).collect()] == [("changed", 4)]


def test_files_that_cannot_be_read(spark):
    gone = spark.createDataFrame([("/not/there", False, 10, 1), ("/not", True, 0, 1)], "path string, is_folder boolean, bytes long, modified_ns long")
    proof = proofs.prove(gone)
    assert [(r.path, r.sha256) for r in proof.collect()] == [("/not/there", None)]
    assert proofs.prove(gone, proof).where("fresh").count() == 1  # tried again
    assert proofs.prove(gone.limit(0)).count() == 0 and proofs.tree(proof.limit(0), "/").count() == 0
