"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: meet(): tables that are broadcast whole, and the share of rows that makes a key hot.
SMALL, HOT = 100_000, 10_000


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a folder of this machine serves a local master
    (tests); on a cluster executors could not see it, so that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sluice-{label}-{uuid.uuid4().hex}"


#: Tables that this driver's operators have saved and not yet cleared.
SAVED: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes the tables that operators have saved so far; only for results that are written or no longer wanted."""
    n = 0
    while SAVED:
        path = spark._jvm.org.apache.hadoop.fs.Path(SAVED.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    SAVED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns the freed memory of this worker to the machine: workers live on, and what runs next needs room beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries decide for themselves
        pass


def tidy(f):
    """f, a function over batches, that gives its memory back when it is through."""

    def run(it):
        yield from f(it)
        give_back()

    return run


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are read, so further columns of any name cannot clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches small: texts can be long. The bounds are the same for all operators, so that it does not matter
    which of several lazy plans set them last."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def is_small(df: DataFrame, small: int = SMALL, wide: Column | None = None) -> bool:
    """Whether a saved table may be broadcast: at most `small` rows, with at most eight times as many values in all in a
    column of lists, whose lengths `wide` gives."""
    if df.count() > small:
        return False
    return wide is None or (df.agg(F.sum(wide)).first()[0] or 0) <= 8 * small


def meet(many: DataFrame, few: DataFrame, on: list[str], small: int = SMALL, hot: int = HOT, wide: Column | None = None) -> DataFrame:
    """many joined with few, saved tables; few has one row for each key and in c how many rows of many have it.

    A small table is broadcast, see is_small(). Of a larger one only its hot keys are, those that hold more than one in
    `hot` of the rows of many, so that there are fewer than `hot` of them, and of these none with a list of over a thousand
    values; the other rows of many are shuffled.
    """
    if is_small(few, small, wide):
        return many.join(F.broadcast(few.drop("c")), on)
    is_hot = F.col("c") * hot > many.count()
    if wide is not None:
        is_hot = is_hot & (wide <= 1000)
    top, rest = F.broadcast(few.where(is_hot).drop("c")), few.where(~is_hot).drop("c")
    return many.join(top, on).unionByName(many.join(top.select(*on), on, "left_anti").join(rest, on))
