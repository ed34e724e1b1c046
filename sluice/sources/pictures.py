"""Pictures to work on: folders in order, numbered sequences, frames cut from sheets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import KINDS
from ..functions.names import natural_key
from ..operators import filters, images, pictures
from ..operators.projects import folder_of, suffix_of
from ..operators.tables import global_rank
from .files import listing

SUFFIXES = [*KINDS["image"], *KINDS["gif"]]


def discover(files: DataFrame, folder: str, recursive: bool = False, suffixes: list[str] | None = None) -> DataFrame:
    """The picture files (path) of a listing that lie in a folder, or anywhere below it; sort by path for their order."""
    inside = F.col("path").startswith(folder.rstrip("/") + "/") if recursive else folder_of(F.col("path")) == folder.rstrip("/")
    return files.where(inside & suffix_of(F.col("path")).isin(suffixes or SUFFIXES))


def identities(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified_ns) of the files at a folder: what a job's identity is made of."""
    return listing(spark, folder).where("NOT is_folder").select("path", "bytes", "modified_ns")


def empty_folders(rows: DataFrame) -> DataFrame:
    """Folders (path) of a listing (path, is_folder) with nothing below them."""
    parents = rows.select(folder_of(F.col("path")).alias("path")).distinct()
    return rows.where("is_folder").select("path").join(parents, "path", "left_anti")


def presence(names: DataFrame, files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """names with, for each kind of companion, whether its file is there: patterns say what it is called ('anim/{}.gif')."""
    out = names
    for kind, pattern in patterns.items():
        before, after = pattern.split("{}")
        there = files.select(F.col("path").alias("_path"), F.lit(True).alias(kind)).distinct()
        out = out.join(there, F.concat(F.lit(before), "name", F.lit(after)) == F.col("_path"), "left").drop("_path").withColumn(kind, F.coalesce(kind, F.lit(False)))
    return out


class TooMuch(ValueError):
    pass


def sequence(spark: SparkSession, folder: str, most_frames: int = 10_000, most_pixels: int = 1 << 30) -> DataFrame:
    """(frame, path, picture) of a folder's pictures by name, numbers by value; over either budget it raises TooMuch. Sizes
    are added up on the executors, so that no more than two numbers reach the driver."""
    found = pictures.read(spark, folder).where("picture IS NOT NULL")
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("picture.height").cast("long") * F.col("picture.width")), F.lit(0)).alias("pixels")).first()
    if total["n"] > most_frames or total["pixels"] > most_pixels:
        raise TooMuch(f"{total['n']} frames of {total['pixels']} pixels")
    ranked = global_rank(found.select("path", natural_key(F.lower(F.regexp_extract("path", "[^/]*$", 0))).alias("name")), ["name", "path"], "frame")
    return ranked.select("frame", "path").join(found, "path").select("frame", "path", "picture")


def cut_boxes(mode: str, height: int, width: int, rows: int = 4, columns: int = 4, cell_height: int = 32, cell_width: int = 32) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of equal parts (grid) or of cells of one size (cell), whole ones only, row by row."""
    if mode == "grid":
        cell_height, cell_width = height // rows, width // columns
    else:
        rows, columns = height // cell_height, width // cell_width
    if cell_height < 1 or cell_width < 1:
        return []
    return [(x * cell_width, y * cell_height, (x + 1) * cell_width, (y + 1) * cell_height) for y in range(rows) for x in range(columns)]


def frames(df: DataFrame, mode: str = "grid", threshold: int = 32, **how) -> DataFrame:
    """(path, frame, box, picture): the frames of sheets (path, picture), by grid, cell or auto (connected visible areas);
    image takes a picture whole."""
    if mode not in ("grid", "cell", "auto", "image"):
        raise ValueError(f"unknown mode {mode!r}")

    def run(it):
        for b in it:
            rows = []
            for path, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = pictures.pixels(p)
                if a is None:
                    continue
                h, w = a.shape[:2]
                if mode == "image":
                    found = [(0, 0, w, h)]
                elif mode == "auto":
                    found = images.boxes((a[..., 3] if a.shape[2] == 4 else np.full((h, w), 255)) > threshold)
                else:
                    found = cut_boxes(mode, h, w, **how)
                rows += [(path, i, ",".join(map(str, box)), pictures.struct_of(part)) for i, (box, part) in enumerate(zip(found, filters.crops(a, found), strict=True))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.string(), pictures.ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "frame", "box", "picture"])

    return df.select("path", "picture").mapInArrow(run, f"path string, frame int, box string, picture {pictures.PICTURE}")


def sheets(df: DataFrame, columns: int = 4, rows: int = 4, cell: int = 128, pad: int = 8) -> DataFrame:
    """(page, picture): pictures (path, picture) in order of path, rows x columns to a sheet; those that are none are left
    out. A sheet, and no more, is put together by one task."""
    from ..operators import passes

    ranked = global_rank(df.where("picture IS NOT NULL").select("path"), ["path"])
    pages = ranked.select("path", F.floor(F.col("rank") / (rows * columns)).alias("page"), "rank").join(df, "path")

    def lay(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        out = passes.sheet([pictures.pixels(p) for p in t["picture"].to_pylist()], columns, cell, pad, rows=rows)
        return pa.table({"page": t["page"].slice(0, 1), "picture": pa.array([pictures.struct_of(out)], pictures.ARROW)})

    return pages.select("page", "rank", "picture").groupBy("page").applyInArrow(lay, f"page long, picture {pictures.PICTURE}")


def leaks(content: bytes) -> list[str]:
    """Names of the chunks of a PNG that say more than its picture does."""
    at, found = 8, []
    while at + 12 <= len(content):
        n, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8].decode("latin-1")
        if name in ("tEXt", "zTXt", "iTXt", "eXIf", "tIME"):
            found.append(name)
        at += 12 + n
    return found
