"""Pictures in DataFrames: read, decoded, filtered and measured, one picture a row, in Arrow batches.

A picture is a struct (height, width, channels, data) of 8-bit samples, RGB or RGBA, row by row. A null picture, or one
whose data does not fit its sizes, gives null.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters, images, passes

PICTURE = "struct<height:int,width:int,channels:int,data:binary>"
ARROW = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
PALETTE = np.array([[0, 0, 0], [85, 85, 85], [170, 170, 170], [255, 255, 255]])


def flat(f):
    """A kernel for the first three channels alone."""
    return lambda a, **p: f(a[..., :3], **p)


#: Kernels by name: picture to picture (or None, where nothing is left of it).
KERNELS = {
    "resize": lambda a, height, width: filters.as_bytes(images.resize(a, height, width)), "offset_wrap": images.offset_wrap, "white_balance": flat(images.white_balance),
    "convolve": lambda a, kernel: filters.as_bytes(filters.convolve(a[..., :3], np.array(kernel, dtype=float))), "box_blur": lambda a, radius=2: filters.as_bytes(filters.box_blur(a[..., :3], radius)),
    "gaussian_blur": lambda a, sigma=1.0: filters.as_bytes(filters.gaussian_blur(a[..., :3], sigma)), "median": lambda a, radius=1: filters.as_bytes(filters.median_filter(a[..., :3], radius)),
    "erode": lambda a, radius=1: filters.erode(a, radius), "flood_alpha": lambda a, **p: np.dstack([a[..., :3], filters.flood_alpha(a[..., :3], **p)]), "chroma_alpha": lambda a, key, **p: np.dstack([a[..., :3], filters.chroma_alpha(a[..., :3], tuple(key), **p)]),
    "premultiply": lambda a: filters.premultiply(passes.opaque(a)), "defringe": lambda a, **p: filters.defringe(passes.opaque(a), **p), "edge_despill": lambda a, screen="green", band=2: passes.edge_despill(passes.opaque(a), screen, band), "despill": flat(passes.despill),
    "matte": lambda a, **p: np.dstack([a[..., :3], passes.matte(a[..., :3], **p)]), "cut_out": lambda a, **p: passes.cut_out(a, **p), "fill_hidden": lambda a: passes.fill_hidden(passes.opaque(a)), "fill_holes": lambda a: passes.fill_holes(passes.opaque(a)),
    "prune": lambda a: np.dstack([a[..., :3], passes.prune(passes.opaque(a)[..., 3])]), "outline": lambda a, **p: filters.outline(passes.opaque(a), **p), "trim_square": lambda a, size, **p: filters.trim_square(passes.opaque(a), size, **p),
    "palette": lambda a, palette=PALETTE, eye=False: np.asarray(palette)[filters.nearest_colour(a[..., :3], np.asarray(palette), eye)].astype(np.uint8), "own_palette": lambda a, colours=8: passes.cel_shade(a, colours),
    "ordered_dither": lambda a, palette=PALETTE, **p: filters.ordered_dither(a[..., :3], np.asarray(palette), **p), "error_diffusion": lambda a, palette=PALETTE, **p: filters.error_diffusion(a[..., :3], np.asarray(palette), **p),
    "pixelize": lambda a, block=2, palette=PALETTE, **p: filters.pixelize(passes.opaque(a), block, np.asarray(palette), **p), "invert": lambda a: 255 - a, "flip_channel": lambda a, channel=1: filters.flip_channel(a, channel), "channel": lambda a, index=0: passes.unpack_channels(a)[index][..., None],
    "pack": lambda a, order: filters.pack_channels(*[a[..., i] for i in order]), "montage": lambda a, down=3, across=3: filters.montage(a, down, across), "crop": lambda a, box: filters.crops(a, [tuple(box)])[0], "wrap_preview": passes.wrap_preview, "seam_strip": passes.seam_strip,
    "surface": lambda a, which="normal", **p: filters.surface_maps(a, **p)[which], "adjust": filters.adjust, "hue": filters.hue, "unsharp": filters.unsharp, "denoise": filters.denoise, "despeckle": filters.despeckle, "dehaze": filters.dehaze,
    "mosaic": lambda a, boxes, block=8: filters.mosaic(a, [tuple(b) for b in boxes], block), "stack": lambda a, steps: filters.apply_stack(a, steps), "retinex": passes.retinex, "recombine": lambda a, weights=None, scales=5: passes.recombine(*filters.wavelet_bands(a, scales), weights),
    "de_gloss": passes.de_gloss, "selective_blur": passes.selective_blur, "shadows_highlights": passes.shadows_highlights, "luma_high_pass": passes.luma_high_pass, "high_pass": passes.high_pass, "edge_boost": passes.edge_boost, "soft_glow": passes.soft_glow,
    "clarity": passes.clarity, "local_contrast": passes.local_contrast, "vignette": passes.vignette, "film_grain": passes.film_grain, "micro_texture": passes.micro_texture, "split_tone": passes.split_tone, "radial_focus": passes.radial_focus, "cel_shade": passes.cel_shade,
    "anime": passes.anime, "red_eye": passes.red_eye, "vibrance": passes.vibrance, "shift": passes.shift, "temperature": passes.temperature, "tint": passes.tint, "frame": passes.frame, "fit": lambda a, height, width: passes.fit(a, height, width),
    "bokeh": lambda a, radius=22.0: passes.bokeh(a, passes.opaque(a)[..., 3], radius), "privacy_blur": lambda a, radius=28.0, block=0: filters.as_bytes(filters.gaussian_blur(a[..., :3], max(1.0, radius))) if block < 2 else filters.mosaic(a[..., :3], [(0, 0, a.shape[1], a.shape[0])], block),
    "checkerboard": lambda a, cell=16: np.repeat(filters.checkerboard(*a.shape[:2], cell)[..., None], 3, -1), "gradient": lambda a, top=(0, 0, 0), bottom=(255, 255, 255): filters.gradient(*a.shape[:2], tuple(top), tuple(bottom)),
    "shrink": lambda a, longest: a if max(a.shape[:2]) <= longest else filters.as_bytes(images.resize(a, max(1, round(a.shape[0] * longest / max(a.shape[:2]))), max(1, round(a.shape[1] * longest / max(a.shape[:2]))))),
    "weighted": lambda a: filters.as_bytes(passes.weighted(a[..., :3])),
}
#: What is measured of a picture: name to (function, SQL type, Arrow type).
MEASURES = {
    "mean": (lambda a: float(a.mean()), "double", pa.float64()),
    "difference_hash": (lambda a: images.difference_hash(a), "string", pa.string()),
    "seam_score": (lambda a: images.seam_scores(a)[2], "double", pa.float64()),
    "noise_sigma": (images.noise_sigma, "double", pa.float64()),
    "coverage": (lambda a: filters.coverage(passes.opaque(a)[..., 3]), "double", pa.float64()),
    "border": (lambda a: "#" + "".join(f"{int(c):02x}" for c in filters.border_colour(a[..., :3])), "string", pa.string()),
    "screen": (lambda a: passes.screen_colour(filters.border_colour(a[..., :3])), "string", pa.string()),
    "boxes": (lambda a: [",".join(map(str, b)) for b in images.boxes(passes.opaque(a)[..., 3] > 0)], "array<string>", pa.list_(pa.string())),
    "profile": (lambda a: json.dumps(passes.profile(a), sort_keys=True), "string", pa.string()),
    "brightness": (lambda a: float(images.resize(images.grey(a), 128, 128).mean() / 255), "double", pa.float64()),
    "contrast": (lambda a: float(images.resize(images.grey(a), 128, 128).std() / 255), "double", pa.float64()),
    "checksum": (lambda a: int((np.arange(1, a.size + 1, dtype=np.int64) * a.ravel()).sum()), "long", pa.int64()),
}


def pixels(p: dict | None) -> np.ndarray | None:
    if p is None or p["data"] is None or not p["height"] or len(p["data"]) != p["height"] * p["width"] * p["channels"]:
        return None
    return np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], p["channels"])


def struct_of(a: np.ndarray | None) -> dict | None:
    if a is None:
        return None
    a = a.reshape(*a.shape[:2], -1)
    return {"height": a.shape[0], "width": a.shape[1], "channels": a.shape[2], "data": a.astype(np.uint8).tobytes()}


def look(a: np.ndarray, name: str) -> np.ndarray:
    """A picture through the passes of a look; its alpha is kept aside, colours under no alpha are filled before."""
    if name not in passes.LOOKS:
        raise ValueError(f"unknown look {name!r}")
    rgb = passes.fill_hidden(a)[..., :3] if a.shape[2] == 4 else a[..., :3]
    for op, params in passes.LOOKS[name]:
        rgb = KERNELS[op](rgb, **params)
    return np.dstack([rgb, a[..., 3]]) if a.shape[2] == 4 else rgb


KERNELS["look"] = look


def local_path(origin) -> Column:
    """The path as other file sources write it."""
    return F.regexp_replace(origin, "^file:/+", "file:/")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, picture) of the picture files at path, by Spark's own decoder; files that it cannot decode have null."""
    from pyspark.sql.pandas.functions import arrow_udf

    df = spark.read.format("image").option("dropInvalid", False).load(path)

    @arrow_udf(PICTURE)
    def rgb(image: pa.Array) -> pa.Array:
        out = []
        for i in image.to_pylist():
            a = None if i is None or i["nChannels"] < 1 or i["height"] < 1 else np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
            out.append(None if a is None else struct_of(a[..., [2, 1, 0, 3][: a.shape[2]]] if a.shape[2] > 1 else np.repeat(a, 3, -1)))
        return pa.array(out, ARROW)

    return df.select(local_path("image.origin").alias("path"), rgb("image").alias("picture"))


def transform(df: DataFrame, kernel: str, column: str = "picture", **params) -> DataFrame:
    """df with its pictures changed by a kernel; other columns stay."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    own = inspect.signature(KERNELS[kernel]).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in own.values()) and not set(params) <= set(own):
        raise ValueError(f"{kernel} takes {sorted(own)[1:]}")
    at = df.columns.index(column)

    def run(it):
        for b in it:
            out = [None if (a := pixels(p)) is None else struct_of(KERNELS[kernel](a, **params)) for p in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(out, ARROW)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def measure(df: DataFrame, names: list[str], column: str = "picture") -> DataFrame:
    """df without its pictures but with these measures of them; null for a picture that is none."""
    rest = [c for c in df.columns if c != column]
    kinds = [MEASURES[n] for n in names]

    def run(it):
        for b in it:
            found = [None if (a := pixels(p)) is None else [f(a) for f, _, _ in kinds] for p in b.column(len(rest)).to_pylist()]
            columns = [pa.array([None if r is None else r[i] for r in found], kind) for i, (_, _, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*rest, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [f"`{n}` {sql}" for n, (_, sql, _) in zip(names, kinds, strict=True)])
    return df.select(*rest, column).mapInArrow(run, schema)


def from_numbers(values: DataFrame, key: str, column: str, side: int) -> DataFrame:
    """(key, picture) from arrays of side * side numbers about 0: red follows the number, green falls with it, blue is half of red."""

    def run(it):
        for b in it:
            out = []
            for v in b.column(1).to_pylist():
                if v is None or len(v) != side * side:
                    out.append(None)
                    continue
                red = np.clip(np.floor((np.array(v, dtype=np.float64) + 0.5) * 255), 0, 255).astype(np.int64).reshape(side, side)
                out.append(struct_of(np.dstack([red, 255 - red, red // 2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, ARROW)], names=[key, "picture"])

    kind = values.schema[key].dataType.simpleString()
    return values.select(key, column).mapInArrow(run, f"`{key}` {kind}, picture {PICTURE}")


def deliver(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Pictures through several kernels; `stage` is the first one that left nothing of a picture, or failed, and such a
    picture goes no further but keeps its place."""

    def run(it):
        for b in it:
            out, stages = [], []
            for p in b.column(b.num_columns - 1).to_pylist():
                a, stage = pixels(p), None if pixels(p) is not None else "read"
                for name, params in steps:
                    if a is None:
                        break
                    try:
                        a = KERNELS[name](a, **params)
                    except (ValueError, IndexError):
                        a = None
                    stage = name if a is None else None
                out.append(struct_of(a))
                stages.append(stage)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, ARROW), pa.array(stages, pa.string())], names=[*b.schema.names, "stage"])

    rest = [c for c in df.columns if c != "picture"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [f"picture {PICTURE}", "stage string"])
    return df.select(*rest, "picture").mapInArrow(run, schema)


@dataclass(frozen=True)
class Preset:
    """What is done to pictures on their way out; scrubbing is what writing them anew does."""

    longest: int | None
    cut: bool

    def steps(self) -> list[tuple[str, dict]]:
        return [("shrink", {"longest": self.longest})] * (self.longest is not None) + [("cut_out", {"method": "solid"})] * self.cut


#: Presets of the delivery.
PRESETS = {"web_delivery": Preset(1200, True), "transparent_cutout": Preset(None, True), "clean_rescale": Preset(1920, False), "privacy_only": Preset(None, False)}


def preview(files: DataFrame, preset: str, source: str, out: str) -> tuple[list[str], DataFrame, bool]:
    """(stages, (path, output) for each file, whether nothing would be written over its source)."""
    p = PRESETS[preset]
    stages = [name for name, on in (("rescale", p.longest), ("cut out", p.cut), ("scrub", True)) if on]
    suffix = F.lit(".png") if p.cut else F.regexp_extract("path", r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return stages, files.select("path", F.concat(F.lit(out.rstrip("/") + "/"), stem, suffix).alias("output")), source.rstrip("/") != out.rstrip("/")


def convert_sets(df: DataFrame, **how) -> DataFrame:
    """(base, role, picture) of texture sets, changed as passes.convert_set does; a set's maps, one a role, go to one task."""

    def run(t: pa.Table) -> pa.Table:
        maps = {r: a for r, p in zip(t["role"].to_pylist(), t["picture"].to_pylist(), strict=True) if (a := pixels(p)) is not None}
        out = passes.convert_set({r: a[..., 0] if a.shape[2] == 1 else a for r, a in maps.items()}, **how)
        rows = [(t["base"][0].as_py(), r, struct_of(a)) for r, a in sorted(out.items())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.string(), ARROW), strict=True)], names=["base", "role", "picture"])

    first = df.dropDuplicates(["base", "role"]).select("base", "role", "picture")
    return first.groupBy("base").applyInArrow(run, f"base string, role string, picture {PICTURE}")


def audit(spark: SparkSession, path: str, oversized: int = 50 << 20, least_side: int = 16) -> DataFrame:
    """One wide record for each file at path: size, digest, format by its first bytes and by its suffix, whether it can be
    decoded, sides, alpha, light and contrast, hash and flags. Files of 0 bytes are only in listings."""
    from ..functions.names import is_unsafe_name
    from ..functions.textures import expected_format, picture_format

    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    facts = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), picture_format(F.col("content")).alias("format"), expected_format(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("expected"), is_unsafe_name(name).alias("unsafe_name"))
    seen = read(spark, path)
    size = seen.select("path", F.col("picture.height").alias("height"), F.col("picture.width").alias("width"), (F.col("picture.channels") == 4).alias("has_alpha"))
    both = facts.join(size, "path", "left").join(measure(seen, ["brightness", "contrast", "difference_hash"]), "path", "left")
    light = F.when(F.col("brightness") <= 0.12, "very_dark").when(F.col("brightness") >= 0.88, "very_bright")
    flags = F.array_compact(F.array(light, F.when(F.col("contrast") <= 0.06, "low_contrast")))
    small = F.coalesce(F.least("height", "width") < least_side, F.lit(False))
    checks = [(F.col("bytes") > oversized).alias("oversized"), F.col("height").isNull().alias("corrupt"), F.coalesce(F.col("format") != F.col("expected"), F.lit(False)).alias("mismatch"), small.alias("tiny"), flags.alias("flags")]
    return both.select(*both.columns, *checks)


PROFILE = "width int, height int, mean_luma double, shadows double, highlights double, saturation double, cast string, cast_strength double, sharpness double, noise double, specular_gap double, noise_sigma double, confidence double, advice string"


def planned_steps(s: dict) -> list[tuple[str, dict]]:
    """The passes that a row of settings asks for, idle ones left out."""
    steps = [("denoise", {"strength": s["denoise"]}, s["denoise"] > 0), ("de_gloss", {"strength": s["de_gloss"], "pore_boost": 1.0 if s["denoise"] > 0 else 1.15}, s["de_gloss"] > 0), ("micro_texture", {"amount": s["micro_texture"]}, s["micro_texture"] > 0)]
    steps += [("clarity", {"amount": s["clarity"]}, s["clarity"] > 0), ("adjust", {"brightness": s["brightness"], "contrast": s["contrast"], "gamma": s["gamma"], "saturation": s["saturation_factor"]}, True)]
    steps += [("temperature", {"amount": s["temperature"]}, s["temperature"] != 0), ("vibrance", {"amount": s["vibrance"]}, s["vibrance"] > 0), ("unsharp", {"amount": (s["sharpen"] - 1) * 1.2}, s["sharpen"] > 1)]
    return [(op, params) for op, params, on in steps if on]


def enhance(df: DataFrame, mode: str = "deterministic", auto: bool = True) -> DataFrame:
    """(path, picture, mode, needs_review, why): each picture profiled, its settings planned as expressions, the passes applied
    and warm surfaces held against the source. What would need a model is enhanced without one, and says so by its mode."""
    from ..functions import enhance as plans

    def profiled(it):
        for b in it:
            found = [None if (a := pixels(p)) is None else json.dumps(passes.profile(a)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["path", "picture", "profile"])

    rows = df.select("path", "picture").mapInArrow(profiled, f"path string, picture {PICTURE}, profile string")
    rows = rows.select("path", "picture", F.from_json("profile", PROFILE).alias("p")).select("path", "picture", "p.*")
    settings = F.to_json(F.struct(*plans.plan(mode, auto, 1).values())).alias("settings")

    def applied(it):
        for b in it:
            out = []
            for p, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                a = pixels(p)
                if a is None:
                    out.append((None, None, None, "read"))
                    continue
                s = json.loads(text)
                rgb = passes.fill_hidden(a)[..., :3] if a.shape[2] == 4 else a[..., :3]
                done = rgb
                for op, params in planned_steps(s):
                    done = KERNELS[op](done, **params)
                review, why = passes.warm_guard(rgb, done)
                out.append((struct_of(np.dstack([done, a[..., 3]]) if a.shape[2] == 4 else done), s["mode"], review, why))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (ARROW, pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", "picture", "mode", "needs_review", "why"])

    return rows.select("path", "picture", settings).mapInArrow(applied, f"path string, picture {PICTURE}, mode string, needs_review boolean, why string")
