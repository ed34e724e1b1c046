"""Proofs of content: digests of blocks, files and folders as a table, and checks that read only what may have changed.

A file's digest is that of its blocks' digests, a folder's that of its entries', up to the root: two trees that agree in a
node agree in all below it. Blocks are hashed by as many tasks as there are, so that one large file is no task's alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sinks import place
from .tables import save

BLOCK = 4 << 20
#: Entries of a folder are put together by so many leading hexadecimal digits of their names' digests first.
FAN = 3


def blocks_of(files: DataFrame, block: int) -> DataFrame:
    """(path, index, sha256) of every block of files (path, bytes), on file systems that Arrow knows; a file that has gone or
    is shorter than its listing says has nulls for what cannot be read."""
    count = F.greatest(F.lit(1), F.ceil(F.col("bytes") / block)).cast("int")
    cut = files.select("path", F.explode(F.sequence(F.lit(0), count - 1)).alias("index"))

    def run(it):
        for b in it:
            found = []
            for path, index in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    fs, name = place(path)
                    with fs.open_input_file(name) as f:
                        f.seek(index * block)
                        data = f.read(block)
                    found.append(hashlib.sha256(data).digest() if data or index == 0 else None)
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["path", "index", "sha256"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, F.xxhash64("path", "index")).mapInArrow(run, "path string, index int, sha256 binary")


def prove(listing: DataFrame, before: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The proof of the files of a listing (path, is_folder, bytes, modified_ns): path, bytes, modified_ns, blocks (a SHA-256
    each), sha256 and `fresh`, whether the file was read.

    With an earlier proof only files are read whose size or time is another than there; the others' digests are taken over.
    A file that cannot be read has null digests. An empty file has one block, of nothing.
    """
    files = listing.where("NOT is_folder").select("path", "bytes", "modified_ns")
    if before is None:
        kept = files.limit(0).select("*", F.lit(None).cast("array<binary>").alias("blocks"), F.lit(None).cast("binary").alias("sha256"))
    else:
        kept = files.join(before.where("sha256 IS NOT NULL").select("path", "bytes", "modified_ns", "blocks", "sha256"), ["path", "bytes", "modified_ns"])
    kept = save(kept, "kept")
    read = save(blocks_of(files.join(kept.select("path"), "path", "left_anti"), block), "blocks")
    lists = read.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "sha256"))), lambda e: e["sha256"]).alias("blocks"))
    lists = lists.withColumn("sha256", F.when(F.forall("blocks", lambda d: d.isNotNull()), F.unhex(F.sha2(F.aggregate("blocks", F.lit(b""), lambda a, d: F.concat(a, d)), 256))))
    fresh = files.join(lists, "path").select("path", "bytes", "modified_ns", "blocks", "sha256", F.lit(True).alias("fresh"))
    return save(kept.withColumn("fresh", F.lit(False)).unionByName(fresh), "proof")


def joined(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, sha256): one digest of all entries (name, sha256) of a group, in order of name."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda e: F.concat(F.unhex(F.sha2(e["name"].cast("binary"), 256)), F.coalesce(e["sha256"], F.lit(b"?"))))
    return entries.groupBy(*by).agg(F.unhex(F.sha2(F.aggregate(each, F.lit(b""), lambda a, d: F.concat(a, d)), 256)).alias("sha256"))


def tree(proof: DataFrame, root: str) -> DataFrame:
    """(path, depth, sha256) of the root, of depth 0, and of every folder with files somewhere below it, and of the files."""
    root = root.rstrip("/")
    nodes = proof.where(F.startswith("path", F.lit(root + "/"))).select("path", (F.size(F.split(F.substr("path", F.lit(len(root) + 1)), "/")) - 1).alias("depth"), "sha256")
    nodes = out = save(nodes, "nodes")
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):  # a round for each level
        here = nodes.where(F.col("depth") == depth)
        named = here.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "sha256")
        part = joined(named.withColumn("part", F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, FAN)), ["folder", "part"])
        above = joined(part.select("folder", F.col("part").alias("name"), "sha256"), ["folder"])
        above = save(above.select(F.col("folder").alias("path"), F.lit(depth - 1).alias("depth"), "sha256"), "folders")
        nodes, out = nodes.unionAll(above), out.unionAll(above)
    return out


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state, block) of the files that two proofs do not agree in: new, gone, changed (with the first block that
    differs, from 0) or unreadable."""
    a = before.select("path", F.col("sha256").alias("a"), F.col("blocks").alias("x"), F.lit(True).alias("was"))
    b = after.select("path", F.col("sha256").alias("b"), F.col("blocks").alias("y"), F.lit(True).alias("there"))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("there").isNull(), "gone").when(F.col("b").isNull(), "unreadable").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    unlike = F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q))
    first = F.array_position(unlike, True).cast("int") - 1
    return both.withColumn("state", state).where("state IS NOT NULL").select("path", "state", F.when(F.col("state") == "changed", first).alias("block"))


def same_below(before: DataFrame, after: DataFrame, path: str) -> bool:
    """Whether two trees agree in all below a path: one digest of each is read."""
    digests = [t.where(F.col("path") == path).select("sha256").first() for t in (before, after)]
    return digests[0] is not None and digests[0] == digests[1]
