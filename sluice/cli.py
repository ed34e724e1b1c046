"""Works on a folder of pictures without a screen: python -m sluice.cli IN OUT --kernel NAME [--params JSON] [--recursive] [--limit N]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import pictures, sinks
from .sources.pictures import SUFFIXES


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Writes the changed pictures as rows (path, png) and a manifest last; returns 0, or 1 where any picture failed."""
    p = argparse.ArgumentParser(prog="sluice")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--kernel", required=True, choices=sorted(pictures.KERNELS))
    p.add_argument("--params", type=json.loads, default={})
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--limit", type=int, help="only the first so many files by path")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    from pyspark.sql.pandas.functions import arrow_udf

    reader = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", a.recursive)
    names = reader.load(a.source).select(pictures.local_path("image.origin").alias("path")).where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    chosen = names.orderBy("path").limit(a.limit) if a.limit is not None else names
    found = pictures.read(spark, a.source) if not a.recursive else pictures.read(spark, a.source.rstrip("/") + "/**")
    done = pictures.deliver(found.join(chosen, "path"), [(a.kernel, a.params)])

    @arrow_udf("binary")
    def encoded(picture):
        import pyarrow as pa

        return pa.array([None if (x := pictures.pixels(p)) is None else sinks.png(x) for p in picture.to_pylist()], pa.binary())

    rows = done.select("path", "stage", encoded("picture").alias("png"))
    rows.write.mode("overwrite").parquet(f"{a.out}/pictures")
    written = spark.read.parquet(f"{a.out}/pictures")
    counts = {"done": written.where("stage IS NULL").count(), "failed": written.where("stage IS NOT NULL").count()}
    sinks.write_json(spark, f"{a.out}/_manifest.json", {"kernel": a.kernel, "params": a.params, "counts": counts})
    return 1 if counts["failed"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
