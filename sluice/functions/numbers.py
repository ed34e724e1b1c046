"""Numbers, times, sizes and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of '0' and '1' of equal length; otherwise the greater length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda x: x))).otherwise(F.greatest(F.length(a), F.length(b)))


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fit_size(w: Column, h: Column, factor: Column, snap: int = 1, upscale: bool = False, most: int = 16384) -> tuple[Column, Column]:
    """(w, h) times factor, at most 8 and at most 1 unless upscaling is allowed; rounded half up, snapped down to a
    multiple, within 1 and `most`."""
    f = F.least(factor, F.lit(8.0))
    f = f if upscale else F.least(f, F.lit(1.0))

    def side(x):
        n = F.least(F.greatest(round_half_up(x * f), F.lit(1)), F.lit(most))
        return F.greatest(F.lit(1), n - F.pmod(n, F.lit(snap))).cast("int") if snap > 1 else n.cast("int")

    return side(w), side(h)


def size_factor(mode: str, w: Column, h: Column, target: float) -> Column:
    """longest_side and fit_inside aim at a length, max_mp at megapixels (never above 1), scale_factor is the factor."""
    if mode in ("longest_side", "fit_inside"):
        return F.lit(float(target)) / F.greatest(w, h)
    if mode == "max_mp":
        return F.least(F.lit(1.0), F.sqrt(F.lit(target * 1e6) / (w * h)))
    return F.lit(float(target))


def bucket(w: Column, h: Column, mode: str = "dimensions") -> Column:
    """WxH, or the orientation by the ratio; unknown without both sides."""
    known = (F.coalesce(w, F.lit(0)) != 0) & (F.coalesce(h, F.lit(0)) != 0)
    if mode == "dimensions":
        return F.when(known, F.concat(w.cast("string"), F.lit("x"), h.cast("string"))).otherwise("unknown")
    ratio = w / F.nullif(h, F.lit(0))
    return F.when(~known, "unknown").when(ratio >= 1.05, "landscape").when(ratio <= 0.95, "portrait").otherwise("square")


def parse_time(text: Column) -> Column:
    """Seconds, mm:ss, hh:mm:ss and so on to seconds; null where it is blank or not finite."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when((F.trim(text) != "") & (F.abs(total) < float("inf")), total)


def format_duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss; --:-- for null, zero and less."""
    s = F.floor(seconds)
    text = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    return F.when(seconds.isNull() | (seconds <= 0), "--:--").otherwise(text)


def parse_rate(rate: Column) -> Column:
    """'30000/1001' or a number; 0 where it is neither."""
    a, b = (F.get(F.split(rate, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
    return F.coalesce(F.when(rate.contains("/"), F.try_divide(a, b)).otherwise(a), F.lit(0.0))


def expected_saving(bpp: Column, threshold: Column, efficient: Column) -> Column:
    """The share that compression is expected to save, up to .85, from bits per pixel over a threshold."""
    return F.round(F.least(F.lit(0.85), F.greatest(F.lit(0.0), 1 - threshold / bpp) * 0.9 + F.when(efficient, 0.0).otherwise(0.20)), 3)


def chroma_alpha(r: Column, g: Column, b: Column, key: tuple[int, int, int], tolerance: float = 100.0, feather: float = 60.0) -> Column:
    """Opacity 0..255 by distance from the key colour."""
    d = F.sqrt((r - key[0]) * (r - key[0]) + (g - key[1]) * (g - key[1]) + (b - key[2]) * (b - key[2]))
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - tolerance) / max(1e-3, feather))) * 255).cast("int")


def despill(r: Column, g: Column, b: Column) -> Column:
    return F.least(g, F.greatest(r, b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def seam_score(a: Column, b: Column, span: float) -> Column:
    """1 where two edges (arrays) are equal, less by the mean of mean and root-mean-square difference over `span`."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (mean(d) + F.sqrt(mean(F.transform(d, lambda x: x * x)))) / 2 / span))
