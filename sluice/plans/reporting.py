"""Reports and files that are written, checked and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projects, sinks, tables
from ..sources import files, pictures
from .registry import query, table


@query(
    """WITH p AS (SELECT d.doc_id AS l, x.doc_id AS r FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) x ON d.doc_id = x.doc_id),
rows AS (SELECT CASE WHEN l IS NULL THEN r || '.txt' ELSE l || '.png' END AS file, CASE WHEN r IS NULL THEN 'missing_caption' WHEN l IS NULL THEN 'orphan_caption' ELSE 'paired' END AS status, CASE WHEN l IS NOT NULL THEN r || '.txt' END AS counterpart FROM p)
SELECT file, status, counterpart, TRUE AS same, (SELECT count(*) FROM rows) AS listed, (SELECT count(*) FROM rows AS s WHERE s.status = rows.status) AS counted FROM rows"""
)
def written_reports(spark, sf_dir):
    """A pair report written as CSV and JSON below one marker and read back: what both files say, the rows that the manifest
    lists, and the count of each status in its summary."""
    left = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("left"))
    right = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("right")).distinct()
    rows, counts = sinks.pair_tables(tables.save(left.join(right, "doc_id", "full_outer").select("left", "right"), "pairs"))
    out = tables.new_path(spark, "report")
    sinks.write_tables(spark, out, {"pairs": rows}, counts)
    schema = "file string, status string, counterpart string"
    if problem := sinks.manifest_problem(spark, out, {"pairs": schema}):
        raise ValueError(problem)
    manifest = sinks.read_json(spark, f"{out}/_manifest.json")
    first = spark.read.schema(schema).option("header", True).csv(f"{out}/pairs.csv")
    second = spark.read.schema(schema).json(f"{out}/pairs.json").withColumnsRenamed({"status": "s", "counterpart": "c"})
    counted = F.coalesce(*[F.when(F.col("status") == k, n) for k, n in manifest["summary"].items()])
    both = first.join(second, "file", "full_outer")
    return both.select("file", "status", "counterpart", (F.col("status").eqNullSafe(F.col("s")) & F.col("counterpart").eqNullSafe(F.col("c"))).alias("same"), F.lit(manifest["tables"]["pairs"]["rows"]).cast("long").alias("listed"), counted.cast("long").alias("counted"))


@query(
    """SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256, CASE WHEN page_id % 5 = 0 THEN 'redo' ELSE 'kept' END AS place, CASE WHEN page_id % 7 = 0 THEN 'size' END AS problem FROM pages"""
)
def copied_files(spark, sf_dir):
    """Each page as a file, found by a listing, then copied or moved with its digest taken on the way; every seventh is said to
    be a byte longer than it is, and so has no copy."""
    top = tables.new_path(spark, "files")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.concat(F.lit(f"{top}/in/g"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("target"))
    made = tables.save(sinks.write_files(pages.withColumn("source", F.col("page_id").cast("string"))), "made")
    listed = files.listing(spark, f"{top}/in").where("NOT is_folder AND path LIKE '%.html'")
    found = tables.save(listed.select(F.regexp_extract("path", "p([0-9]+)[.]html$", 1).cast("long").alias("page_id"), F.col("path").alias("source"), "bytes"), "found")
    moves = found.withColumn("bytes", F.col("bytes") + (F.col("page_id") % 7 == 0).cast("int")).withColumn("target", F.concat(F.lit(f"{top}/"), F.when(F.col("page_id") % 5 == 0, "redo").otherwise("kept"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")))
    copied = tables.save(sinks.copy_files(moves.where("page_id % 5 > 0")).unionAll(sinks.copy_files(moves.where("page_id % 5 = 0"), move=True)), "copied")
    there = files.listing(spark, top).where("NOT is_folder AND path NOT LIKE '%/in/%'").select(F.regexp_extract("path", "p([0-9]+)[.]html$", 1).cast("long").alias("page_id"), F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("is_at"))
    rows = copied.join(found.select("source", "page_id"), "source").withColumnsRenamed({"bytes": "copied_bytes", "sha256": "copied_sha"})
    rows = rows.join(made.select(F.col("source").cast("long").alias("page_id"), "bytes", "sha256"), "page_id").join(there, "page_id", "left")
    place = F.when(F.col("page_id") % 5 == 0, "redo").otherwise("kept")
    failed = F.col("error").contains("bytes of") & F.col("is_at").isNull()
    same = (F.col("copied_sha") == F.col("sha256")) & (F.col("copied_bytes") == F.col("bytes")) & (F.col("is_at") == place)
    return rows.select("page_id", "bytes", "sha256", place.alias("place"), F.when(F.coalesce(same, F.lit(False)), F.lit(None)).when(failed, "size").otherwise("wrong").alias("problem"))


@query(
    """SELECT 'g' || (page_id % 9) AS folder, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes, min(page_id) AS first, page_id % 9 = 4 AS is_empty FROM pages WHERE page_id % 9 <> 4 GROUP BY page_id % 9 UNION ALL SELECT 'g4', 0, 0, NULL, TRUE"""
)
def discovered_folders(spark, sf_dir):
    """Files found below a folder, by folder: their identities (path, size), the first by natural order, and empty folders."""
    top = tables.new_path(spark, "discover")
    pages = table(spark, sf_dir, "pages").where("page_id % 9 <> 4").select(F.col("page_id").cast("string").alias("source"), F.col("html").cast("binary").alias("content"), F.concat(F.lit(f"{top}/g"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".png")).alias("target"))
    sinks.Files(spark, top).make(f"{top}/g4")
    tables.save(sinks.write_files(pages), "made")
    rows = tables.save(files.listing(spark, top), "listing")
    found = pictures.discover(rows, rows.orderBy(F.length("path")).first()["path"], recursive=True)
    number = F.regexp_extract("path", "p([0-9]+)[.]png$", 1).cast("long")
    full = found.groupBy(F.regexp_extract("path", "/(g[0-9])/", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min(number).alias("first"))
    empty = pictures.empty_folders(rows).select(projects.stem_of(F.col("path")).alias("folder"))
    return full.withColumn("is_empty", F.lit(False)).unionByName(empty.select("folder", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("is_empty")))


PACKED = "SELECT 'a' || (page_id % 23) || CASE WHEN page_id % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS archive, CASE WHEN page_id % 17 = 0 THEN '../up/' || page_id ELSE 'docs/p' || page_id || '.html' END AS name, html FROM pages"


@query(
    f"""WITH m AS (SELECT archive, name, html, row_number() OVER (PARTITION BY archive ORDER BY name) - 1 AS ord, sum(strlen(html)) OVER (PARTITION BY archive ORDER BY name ROWS UNBOUNDED PRECEDING) AS declared FROM ({PACKED})),
s AS (SELECT *, CASE WHEN ord >= 50 OR declared > 150000 THEN 'aborted' WHEN starts_with(name, '..') THEN 'rejected' ELSE 'written' END AS status FROM m)
SELECT archive, ord, name AS path, status, CASE WHEN status = 'written' THEN CAST(strlen(html) AS BIGINT) END AS bytes, CASE WHEN status = 'written' THEN sha256(html) END AS sha256 FROM s"""
)
def ranged_archives(spark, sf_dir):
    """Pages packed into archive files, then read member by member by ranges, each archive up to its budgets."""
    from ..sources import archives, ranged

    top = tables.new_path(spark, "archives")
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    built = archives.build(spark.sql(PACKED).withColumnRenamed("html", "data")).withColumnsRenamed({"path": "source"})
    made = tables.save(sinks.write_files(built.withColumn("target", F.concat(F.lit(f"{top}/"), "source"))), "made")
    plan = ranged.planned(ranged.catalog(made.select(F.col("target").alias("path"))), archives.Limits(total=150_000, members=50))
    found = ranged.extracted(plan)
    return found.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "ord", "path", "status", "bytes", "sha256")


@query(
    f"""WITH m AS (SELECT archive, name, html, row_number() OVER (PARTITION BY archive ORDER BY name) - 1 AS ord FROM ({PACKED}))
SELECT archive, ord, name AS path, CASE WHEN starts_with(name, '..') THEN 'rejected' ELSE 'written' END AS status, CASE WHEN NOT starts_with(name, '..') THEN sha256(html) END AS sha256 FROM m"""
)
def parallel_archives(spark, sf_dir):
    """Pages packed into archives by many tasks, block by block, and read back member by member."""
    from ..sources import packing, ranged

    top = tables.new_path(spark, "archives")
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    made = tables.save(packing.write(packing.pieces(spark.sql(PACKED).withColumnRenamed("html", "data")), top), "made")
    found = ranged.extracted(ranged.planned(ranged.catalog(made.select("path"))))
    return found.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "ord", "path", "status", "sha256")


@query(
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'gone' WHEN page_id % 7 = 0 THEN 'changed' ELSE 'new' END AS state, CASE WHEN page_id % 11 <> 0 AND page_id % 7 = 0 THEN CAST(strlen(html) // 1000 AS INTEGER) END AS block,
page_id % 11 <> 0 AS fresh FROM pages WHERE page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 13 = 0"""
)
def content_proof(spark, sf_dir):
    """Pages as files, proved twice: some went, some came, some grew by a letter. What differs, in which block, and whether
    it was read for the second proof; files that had not changed were not."""
    from ..operators import proofs

    top = tables.new_path(spark, "proof")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source"), "page_id", F.col("html").cast("binary").alias("content"), F.concat(F.lit(f"{top}/g"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string")).alias("target"))
    late = "page_id % 13 = 0 AND page_id % 11 > 0 AND page_id % 7 > 0"
    tables.save(sinks.write_files(pages.where(f"NOT ({late})")), "made")
    first = proofs.prove(files.listing(spark, top), block=1000)
    tables.save(sinks.write_files(pages.where(f"{late} OR page_id % 7 = 0 AND page_id % 11 > 0").withColumn("content", F.when(F.col("page_id") % 7 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))), "made")
    away = pages.where("page_id % 11 = 0").select(F.col("target").alias("source"), F.concat(F.lit(f"{top}-away/p"), "source").alias("target"), F.lit(None).cast("long").alias("bytes"))
    tables.save(sinks.copy_files(away, move=True), "away")
    second = proofs.prove(files.listing(spark, top), first, block=1000)
    number = F.regexp_extract("path", "p([0-9]+)$", 1).cast("long")
    found = proofs.differences(first, second).join(second.where("fresh").select("path", "fresh"), "path", "full_outer")
    return found.select(number.alias("page_id"), "state", "block", F.coalesce("fresh", F.lit(False)).alias("fresh"))
