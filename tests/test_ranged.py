"""Archives by ranges: contents in pieces, budgets before extraction, damage."""

import gzip
import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from sluice.sources import ranged
from sluice.sources.archives import Limits


def packed(tmp_path, name, files):
    path = tmp_path / name
    if name.endswith(".zip"):
        with zipfile.ZipFile(path, "w") as z:
            z.mkdir("folder")
            for i, (n, data) in enumerate(files):
                z.writestr(n, data, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    else:
        with tarfile.open(path, {"gz": "w:gz", "z2": "w:bz2", "xz": "w:xz"}.get(name[-2:], "w")) as t:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for n, data in files:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
    return str(path)


def some_files():
    rng = random.Random(2)
    files = [(f"d/f{i}.{'txt' if i % 3 else 'bin'}", rng.randbytes(rng.randrange(3000)) + b"a" * rng.randrange(5000)) for i in range(20)]
    return [*files, ("../out.txt", b"x"), ("D/F0.BIN", b"again"), ("empty", b""), ("big.bin", rng.randbytes(90_000) + b"z" * 200_000)]


@pytest.mark.parametrize("name", ["a.zip", "a.tar", "a.tar.gz", "a.tar.bz2", "a.txz"])
def test_contents_come_in_pieces(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(ranged, "PIECE", 4096)
    files = some_files()
    paths = spark.createDataFrame([(packed(tmp_path, name, files),), (None,)], "path string")
    plan = ranged.planned(ranged.catalog(paths))
    found = {r.ord: r for r in ranged.extracted(plan).collect()}
    statuses = {"../out.txt": "rejected", "D/F0.BIN": "repeated"}
    for i, (n, data) in enumerate(files):
        r = found[i]
        want = statuses.get(n, "written")
        assert r.status == want and (want != "written" or (r.path, r.bytes, r.sha256) == (n, len(data), hashlib.sha256(data).hexdigest()))
    assert len(found) == len(files) + (name != "a.zip") and (name == "a.zip" or found[len(files)].status == "skipped")
    whole: dict[int, list] = {}
    for r in ranged.contents(plan).collect():
        assert len(r.data) <= 1 << 20
        whole.setdefault(r.ord, []).append((r.place, bytes(r.data)))
    for i, (n, data) in enumerate(files):
        if n not in statuses and data:
            assert b"".join(d for _, d in sorted(whole[i])) == data


def test_a_tar_of_many_gzip_members(spark, tmp_path):
    with tarfile.open(packed(tmp_path, "one.tar", some_files())) as t:
        names = [m.name for m in t if m.isfile()]
    plain = (tmp_path / "one.tar").read_bytes()
    (tmp_path / "many.tar.gz").write_bytes(b"".join(gzip.compress(plain[i : i + 700]) for i in range(0, len(plain), 700)))
    rows = ranged.catalog(spark.createDataFrame([(f"{tmp_path}/many.tar.gz",)], "path string")).where("reason = ''").orderBy("ord").collect()
    assert [r.member for r in rows] == names


def test_budgets_hold_before_anything_is_read(spark, tmp_path):
    files = [(f"f{i}", bytes(1000)) for i in range(10)]
    paths = spark.createDataFrame([(packed(tmp_path, "a.zip", files),), (packed(tmp_path, "b.tar", files[:3]),)], "path string")
    listed = ranged.catalog(paths)

    def statuses(limits):
        return [(r.archive[-5:], r.ord, r.status) for r in ranged.planned(listed, limits).orderBy("archive", "ord").collect() if r.member != "link"]

    assert [s for *_, s in statuses(Limits(total=4500))] == ["chosen"] * 4 + ["aborted"] * 6 + ["chosen"] * 3
    assert [s for *_, s in statuses(Limits(members=2))] == ["chosen"] * 2 + ["aborted"] * 8 + ["chosen"] * 2 + ["aborted"]
    assert {s for *_, s in statuses(Limits(member=999))} == {"aborted"} and {s for *_, s in statuses(Limits(suffixes=(".txt",)))} == {"skipped"}


def test_damage(spark, tmp_path):
    files = [(f"f{i}", random.Random(i).randbytes(2000)) for i in range(6)]
    good = packed(tmp_path, "good.zip", files)
    data = bytearray(open(good, "rb").read())
    data[data.index(files[2][1]) + 7] ^= 1
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    (tmp_path / "junk.zip").write_bytes(b"junk")
    (tmp_path / "cut.tar.gz").write_bytes(open(packed(tmp_path, "whole.tar.gz", files), "rb").read()[:6000])
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("bad.zip", "junk.zip", "cut.tar.gz", "gone.zip", "what.txt")], "path string")
    found = {}
    for r in ranged.extracted(ranged.planned(ranged.catalog(paths))).collect():
        found.setdefault(r.archive.rpartition("/")[2], {})[r.ord] = r
    assert [found["bad.zip"][i].status for i in range(6)] == ["written", "written", "error", "written", "written", "written"] and "directory" in found["bad.zip"][2].reason
    for name in ("junk.zip", "gone.zip", "what.txt"):
        assert [r.status for r in found[name].values()] == ["error"] and found[name][0].reason
    assert "error" in {r.status for r in found["cut.tar.gz"].values()}
