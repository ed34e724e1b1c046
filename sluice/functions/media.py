"""What to do with media files, decided from their names and probes: kinds, codecs, filter chains, glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files by suffix.
KINDS = {
    "image": [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".ico"],
    "video": [".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".flv", ".wmv"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".opus"],
    "markdown": [".md", ".markdown"],
    "html": [".html", ".htm"],
    "docx": [".docx"],
    "pdf": [".pdf"],
    "gif": [".gif"],
}
# Encoder and whether it takes a bit rate, by suffix of the target.
CODECS = {".mp3": ("libmp3lame", True), ".wav": ("pcm_s16le", False), ".flac": ("flac", False), ".aac": ("aac", True), ".m4a": ("aac", True), ".ogg": ("libvorbis", True), ".opus": ("libopus", True)}
# Video codecs that are compact already.
EFFICIENT = ["hevc", "h265", "av1", "vp9"]
# Characters by the names that files give them.
GLYPHS = {
    "space": " ", "sp": " ", "exclamation": "!", "exclam": "!", "question": "?", "period": ".", "dot": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "dash": "-", "minus": "-",
    "plus": "+", "equal": "=", "equals": "=", "slash": "/", "backslash": "\\", "at": "@", "hash": "#", "numbersign": "#", "percent": "%", "ampersand": "&", "asterisk": "*", "star": "*",
    "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "underscore": "_", "quote": "'", "quotesingle": "'", "quotedbl": '"',
    "tilde": "~", "caret": "^", "grave": "`", "bar": "|", "dollar": "$", "euro": "€", "pound": "£", "yen": "¥",
}


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def source_kind(suffix: Column) -> Column:
    """The kind of a file by its suffix; '' where it is unknown."""
    return lookup(F.lower(suffix), {s: kind for kind, all_ in KINDS.items() for s in all_}, F.lit(""))


def codec_arguments(suffix: Column, bitrate: str) -> Column:
    """Arguments of the audio encoder for a target; null where there is none."""
    out = F.lit(None).cast("array<string>")
    for s, (name, rated) in CODECS.items():
        out = F.when(F.lower(suffix) == s, F.array(*map(F.lit, ["-c:a", name, *(["-b:a", bitrate] if rated else [])]))).otherwise(out)
    return out


def compact(x: Column) -> Column:
    """A number without needless digits: 3, 2.5."""
    return F.regexp_replace(F.round(x.cast("double"), 6).cast("string"), r"\.0$", "")


def filter_chain(fade_in: Column, fade_out: Column, normalize: Column, duration: Column) -> Column:
    """Fades and loudness as one chain; the fade-out ends with the sound. '' where there is nothing to do."""
    start = F.greatest(F.lit(0.0), F.coalesce(duration - fade_out, F.lit(0.0)))
    steps = F.array(
        F.when(fade_in > 0, F.concat(F.lit("afade=t=in:st=0:d="), compact(fade_in))),
        F.when(fade_out > 0, F.concat(F.lit("afade=t=out:st="), compact(start), F.lit(":d="), compact(fade_out))),
        F.when(normalize, F.lit("loudnorm")),
    )
    return F.array_join(F.array_compact(steps), ",")


def assess(codec: Column, bpp: Column, lean_efficient: float, lean_other: float, least_saving: float = 0.15) -> tuple[Column, Column]:
    """(decision, expected saving) of compressing a video, by its bits per pixel: lean files are skipped, as are those
    that would save little; a file of unknown rate is tried."""
    from .numbers import expected_saving

    efficient = F.lower(codec).isin(EFFICIENT)
    lean = F.when(efficient, F.lit(lean_efficient)).otherwise(lean_other)
    unknown = F.coalesce(bpp, F.lit(0.0)) <= 0
    saving = F.when(unknown, 0.30).when(bpp <= lean, 0.0).otherwise(expected_saving(bpp, lean, efficient))
    return F.when(~unknown & ((bpp <= lean) | (saving < least_saving)), "skip").otherwise("compress"), saving


def plausible_length(actual: Column, expected: Column) -> Column:
    """Whether a cut may be as long as it is for what was asked; never shorter than a hundredth of a second."""
    finite = ~F.isnan(actual) & (F.abs(actual) < float("inf"))
    floor = F.greatest(F.lit(0.01), F.least(expected * 0.25, F.lit(0.25)))
    return finite & actual.between(floor, expected + F.greatest(F.lit(1.0), expected * 0.5))


def glyph(name: Column) -> Column:
    """The character that a file name stands for: itself, a named one, cap_x or small_x, or a code point; else null."""
    raw = F.trim(name)
    last = F.substring(raw, -1, 1)
    code = F.regexp_extract(raw, r"(?i)^(?:uni|u\+|u|0x)([0-9a-f]{4,6})$", 1)
    point = F.conv(F.nullif(code, F.lit("")), 16, 10).cast("long")
    return (
        F.when(F.length(raw) == 1, raw)
        .when(F.lower(raw).isin(list(GLYPHS)), lookup(F.lower(raw), GLYPHS))
        .when(raw.rlike("(?i)^(cap|upper)_."), F.upper(last))
        .when(raw.rlike("(?i)^(small|lower)_."), F.lower(last))
        .when(point.between(1, 0x10FFFF), from_code_point(point))
    )


def from_code_point(point: Column) -> Column:
    """The character of a code point, by way of its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def hex_colour(text: Column) -> Column:
    """'#rrggbb' as three numbers; pure green where it is none."""
    digits = F.regexp_extract(text, r"^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.array(part(1), part(3), part(5))).otherwise(F.array(F.lit(0), F.lit(255), F.lit(0)))


def first_score(log: Column) -> Column:
    """The first VMAF score in a log."""
    return F.regexp_extract(log, r"(?i)vmaf[^0-9]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
