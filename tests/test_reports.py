"""Two-phase writes: what a reader sees after success, failure and repetition."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from sluice.sources import reports

SCHEMA = "id long, name string, value double, day date"


def rows_of(spark, n, first=0):
    name = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' WHEN id % 7 = 2 THEN 'a, \"b\"' ELSE concat('n', id) END"
    return spark.range(first, first + n).repartition(5).selectExpr("id", f"{name} AS name", "if(id % 5 = 0, NULL, id / 4.0D) AS value", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day")


def values(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def parts(path):
    return sorted(os.listdir(f"{path}/parts")) if os.path.isdir(f"{path}/parts") else []


@pytest.mark.parametrize("kind", ["parquet", "csv"])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_write_append_and_overwrite(spark, tmp_path, kind, scheme):
    path = f"{scheme}{tmp_path}/out"
    reports.publish_rows(rows_of(spark, 100), path, kind)
    assert values(reports.published(spark, path)) == values(rows_of(spark, 100))
    manifest = json.loads((tmp_path / "out/_manifest.json").read_text())
    assert manifest["rows"] == 100 and [f["name"] for f in manifest["files"]] == parts(tmp_path / "out") and len(manifest["files"]) == 5
    reports.publish_rows(rows_of(spark, 50, 100), path, kind, "append")
    assert values(reports.published(spark, path)) == values(rows_of(spark, 150))
    reports.publish_rows(rows_of(spark, 3), path, kind)
    assert values(reports.published(spark, path)) == values(rows_of(spark, 3)) and len(parts(tmp_path / "out")) <= 3
    reports.publish_rows(rows_of(spark, 0), path, kind)
    assert reports.published(spark, path).count() == 0 and parts(tmp_path / "out") == []


def test_a_failed_task_leaves_no_mark(spark, tmp_path):
    path = f"{tmp_path}/out"
    bad = rows_of(spark, 100).where("id != 50 OR raise_error('this row cannot be written') IS NULL")
    with pytest.raises(Exception, match="cannot be written"):
        reports.publish_rows(bad, path)
    assert not os.path.exists(f"{path}/_manifest.json") and parts(path) == []
    with pytest.raises(Exception, match="nothing was committed"):
        reports.published(spark, path)
    reports.publish_rows(rows_of(spark, 10), path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="cannot be written"):
            reports.publish_rows(bad, path, mode=mode)
        assert values(reports.published(spark, path)) == values(rows_of(spark, 10)) and reports.sweep(path) == 0


def test_a_failed_commit_leaves_all_as_it_was(spark, tmp_path):
    path = f"{tmp_path}/out"
    reports.publish_rows(rows_of(spark, 10), path)
    with pytest.raises(Exception, match="another schema"):
        reports.publish_rows(rows_of(spark, 10).drop("day"), path, mode="append")
    assert values(reports.published(spark, path)) == values(rows_of(spark, 10)) and reports.sweep(path) == 0


def test_parts_of_killed_tasks_do_not_count(spark, tmp_path):
    path = f"{tmp_path}/out"
    reports.publish_rows(rows_of(spark, 10), path)
    (tmp_path / "out/parts/killed.parquet").write_bytes(b"half a part")
    assert values(reports.published(spark, path)) == values(rows_of(spark, 10))
    assert reports.sweep(path) == 1 and "killed.parquet" not in parts(path)


def test_a_changed_part_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/out"
    reports.publish_rows(rows_of(spark, 10).coalesce(1), path, "csv")
    part = tmp_path / "out/parts" / parts(path)[0]
    part.write_bytes(part.read_bytes().replace(b"n3", b"n4"))
    with pytest.raises(Exception, match="not what its manifest names"):
        reports.published(spark, path).collect()


def test_streams_count_each_batch_once(spark, tmp_path):
    source, path, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    rows_of(spark, 40).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    reports.publish_stream(stream, path, check)
    rows_of(spark, 20, 40).coalesce(1).write.mode("append").parquet(source)
    reports.publish_stream(stream, path, check)
    assert values(reports.published(spark, path)) == values(rows_of(spark, 60))
    batches = sorted(os.listdir(f"{path}/_batches"))
    assert batches == ["000000000000.json", "000000000001.json"]
    os.unlink(f"{check}/commits/1")  # as if the driver had died between the sink's commit and its own
    for crc in (f"{check}/commits/.1.crc",):
        os.path.exists(crc) and os.unlink(crc)
    reports.publish_stream(stream, path, check)
    assert values(reports.published(spark, path)) == values(rows_of(spark, 60)) and reports.sweep(path) == 0


def test_messages_alone_decide(tmp_path):
    import pyarrow as pa

    schema = StructType().add("x", "long")
    writer = reports.BatchWriter({"path": str(tmp_path)}, schema)
    batch = pa.RecordBatch.from_pydict({"x": pa.array([1, 2], pa.int64())})
    first, second, empty = writer.write(iter([batch])), writer.write(iter([batch, batch])), writer.write(iter([]))
    writer.commit([first, None, empty], 7)
    writer.commit([second], 7)  # the same batch again
    assert [f["name"] for m in reports.manifests(str(tmp_path)) for f in m["files"]] == [first.name] == parts(tmp_path)
    writer.abort([writer.write(iter([batch])), None], 8)
    assert parts(tmp_path) == [first.name] and (first.rows, empty.name) == (2, None)
    with pytest.raises(ValueError):
        reports.TableWriter({"path": str(tmp_path), "kind": "xml"}, schema, True)


def test_many_types(spark, tmp_path):
    df = spark.sql("SELECT array(1, NULL) AS a, map('k', 1.5D) AS m, struct(1 AS x, 'y' AS y) AS s, CAST(1.25 AS DECIMAL(10,2)) AS d, TIMESTAMP'2024-01-01 00:00:00' AS t, true AS b, X'00FF' AS z, CAST(NULL AS STRING) AS n")
    reports.publish_rows(df, f"{tmp_path}/out")
    got = reports.published(spark, f"{tmp_path}/out")
    assert got.schema == df.schema.fromJson(got.schema.jsonValue()) and got.select(F.to_json(F.struct("*"))).collect() == df.select(F.to_json(F.struct("*"))).collect()
