import io
import os
import tarfile
import zipfile

from pyspark.sql import functions as F
from sluice.sources import files
from sluice.sources.files import ArchiveMembers, listing
from sluice.streaming.jobs import fold, fold_events


def test_listing_has_empty_files_and_folders(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/x.txt").write_text("hello")
    (tmp_path / "a/b/zero").touch()
    (tmp_path / "top.bin").write_bytes(b"123")
    rows = {r.path.removeprefix(str(tmp_path)): (r.is_folder, r.bytes) for r in listing(spark, str(tmp_path)).collect()}
    assert rows == {"": (True, 0), "/a": (True, 0), "/a/b": (True, 0), "/empty": (True, 0), "/a/x.txt": (False, 5), "/a/b/zero": (False, 0), "/top.bin": (False, 3)}


def made(top, n=60):
    (top / "many").mkdir(parents=True)
    (top / "x/y/z").mkdir(parents=True)
    for k in range(n):
        (top / f"many/f{k:03d}.{'png' if k % 3 else 'txt'}").write_bytes(b"a" * k)
    (top / "x/y/z/deep.txt").write_text("deep")
    (top / "x/link.txt").symlink_to(top / "many")


def plain_listing(top):
    out = []
    for folder, below, names in os.walk(top):
        links = [d for d in below if os.path.islink(os.path.join(folder, d))]
        out.append((folder, True, 0))
        out += [(p := os.path.join(folder, n), False, os.lstat(p).st_size) for n in [*names, *links]]
    return sorted(out)


def listed(df):
    return sorted((r.path, r.is_folder, r.bytes) for r in df.collect())


def test_a_large_folder_is_shared(spark, tmp_path, monkeypatch):
    made(tmp_path)
    tasks = files.planned(str(tmp_path))
    assert len(tasks) == 5
    monkeypatch.setattr(files, "SLICE", 7)
    tasks = files.planned(str(tmp_path))
    many = [t for t in tasks if t.path.endswith("many")]
    found = [list(files.rows_below(t, files.Test())) for t in many]
    assert len(many) == 9 and max(map(len, found)) < 20 and sum(map(len, found)) == 61
    assert sorted(r[:3] for t in tasks for r in files.rows_below(t, files.Test())) == plain_listing(tmp_path)
    monkeypatch.setattr(files, "PLANNED", 1)
    assert sorted(r[:3] for t in files.planned(str(tmp_path)) for r in files.rows_below(t, files.Test())) == plain_listing(tmp_path)


def test_filters_are_pushed(spark, tmp_path):
    made(tmp_path)
    rows = files.listing(spark, f"file://{tmp_path}")
    assert listed(rows) == plain_listing(tmp_path)
    chosen = rows.where("path LIKE '%.txt' AND bytes >= 30 AND NOT is_folder AND bytes != 33 AND modified_ns > 0")
    assert listed(chosen) == [r for r in plain_listing(tmp_path) if r[0].endswith(".txt") and r[2] >= 30 and r[2] != 33 and not r[1]]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BatchScan")]
    assert "bytes" in above and "EndsWith" not in above and ">= 30" not in above  # only what is not pushed is left to Spark
    assert listed(rows.where("is_folder")) == [r for r in plain_listing(tmp_path) if r[1]] and rows.where("bytes IN (3, 5)").count() == 2


def test_exploring_by_levels(spark, tmp_path):
    made(tmp_path)
    roots = spark.createDataFrame([(str(tmp_path),), (f"file://{tmp_path}/",), (f"{tmp_path}/x",), (None,), (f"{tmp_path}/not there",)], "path string")
    assert listed(files.explored(spark, roots)) == plain_listing(tmp_path)
    assert files.explored(spark, roots.limit(0)).count() == 0


def test_changes_as_a_stream(spark, tmp_path):
    made(tmp_path / "in", 5)
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"

    def step():
        q = files.changes(spark, f"{tmp_path}/in").writeStream.format("json").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination()
        rows = [r for r in spark.read.schema(files.SCHEMA).json(out).collect()]
        return sorted((r.path.removeprefix(f"{tmp_path}/in"), r.bytes) for r in rows if not r.is_folder)

    first = step()
    assert first == sorted((p.removeprefix(f"{tmp_path}/in"), n) for p, d, n in plain_listing(tmp_path / "in") if not d)
    assert step() == first
    (tmp_path / "in/many/f001.png").write_bytes(b"changed")
    (tmp_path / "in/new.txt").write_text("new")
    old = tmp_path / "old.txt"
    old.write_text("moved in")
    os.utime(old, (1, 1))
    old.rename(tmp_path / "in/x/old.txt")
    assert step() == sorted([*first, ("/many/f001.png", 7), ("/new.txt", 3), ("/x/old.txt", 8)])


def test_archive_members(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("good.txt", "abc")
        f.writestr("../escape.txt", "x")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("Assets/foo/bar.txt")
        info.size = 4
        f.addfile(info, io.BytesIO(b"data"))
    df = spark.createDataFrame([(1, z.getvalue()), (2, t.getvalue()), (3, b"junk")], "id int, content binary")
    spark.udtf.register("archive_members", ArchiveMembers)
    df.createOrReplaceTempView("archives")
    rows = spark.sql("SELECT id, m.* FROM archives, LATERAL archive_members(content) m").collect()
    assert sorted((r.id, r.member or "", r.bytes or 0) for r in rows) == [(1, "../escape.txt", 1), (1, "good.txt", 3), (2, "Assets/foo/bar.txt", 4), (3, "", 0)]


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    want = fold(spark.read.parquet(f"{sf}/events.parquet")).orderBy("user_id").collect()
    assert fold_events(spark, sf).orderBy(F.col("user_id")).collect() == want
