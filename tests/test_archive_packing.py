"""Archives made by many tasks against one loop, and against the standard library's readers."""

import io
import random
import tarfile
import zipfile
import zlib

import pytest
from sluice.sources import packing


def test_combined_crcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(70_000))
        assert packing.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("partitions", [1, 7])
def test_bytes_do_not_depend_on_partitions(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(packing, "BLOCK", 1000)
    rng = random.Random(2)
    files = {name: [(f"d/{'ü' if i % 5 == 0 else 'f'}{i}", rng.randbytes(rng.randrange(700)) + b"a" * rng.randrange(6000)) for i in range(12)] + [("empty", b""), ("exact", bytes(2000))] for name in ("a.zip", "b.tar.gz", "sub/c.zip", "d.unitypackage")}
    rows = [(a, n, d) for a, each in files.items() for n, d in each]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "archive string, name string, data binary").repartition(partitions)
    written = packing.write(packing.pieces(df), f"{tmp_path}").collect()
    assert {r.archive for r in written} == set(files)
    for archive, each in files.items():
        data = (tmp_path / archive).read_bytes()
        assert data == packing.serial(archive, each) and len(data) == next(r.bytes for r in written if r.archive == archive)
        if archive.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == dict(each) and z.namelist() == sorted(n for n, _ in each)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                assert {m.name: t.extractfile(m).read() for m in t} == dict(each)
    assert packing.pieces(df.limit(0)).count() == 0 and not list(tmp_path.glob("**/*.part"))


def test_gaps_and_sizes_are_errors(spark, tmp_path, monkeypatch):
    lost = spark.createDataFrame([("a.zip", 0, b"abc"), ("a.zip", 4, b"d")], packing.PIECES)
    with pytest.raises(Exception, match="a piece at 4 instead of 3"):
        packing.write(lost, f"{tmp_path}").collect()
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(packing, "MOST_MEMBERS", 1)
    df = spark.createDataFrame([("a.zip", "x", b"1"), ("a.zip", "y", b"2")], "archive string, name string, data binary")
    with pytest.raises(Exception, match="needs a tar"):
        packing.pieces(df).collect()
