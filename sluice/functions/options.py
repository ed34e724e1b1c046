"""Checks of tool settings: for each tool the rules that its settings must meet, and the message of the first one broken.

A rule is (condition, message), both SQL over the columns of the settings;
MATCH(x, 'p') stands for a match of the whole of x. A null setting breaks the rules that read it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: str, low: int, high: int, message: str) -> tuple[str, str]:
    return f"{x} = floor({x}) AND {x} BETWEEN {low} AND {high}", f"'{message}'"


# Limits and messages.
COLOUR_SPACE = "441.6729559300637"  # the root of 3 * 255 * 255
RULES: dict[str, list[tuple[str, str]]] = {
    "dataset": [
        ("operation IN ('pair_report', 'replace', 'bucket', 'split')", "concat('unknown operation: ', operation)"),
        ("bucket_mode IN ('dimensions', 'aspect')", "concat('unknown bucket mode: ', bucket_mode)"),
        ("n_exts BETWEEN 1 AND 16", "'provide between 1 and 16 caption extensions'"),
        ("MATCH(exts, '(,?\\.[a-z0-9][a-z0-9_-]{0,15})+')", "'caption extensions must be unique safe suffixes such as .txt'"),
        ("train >= 0 AND val >= 0 AND test >= 0 AND train + val + test > 0 AND train + val + test < 1e300", "'split ratios must be three finite non-negative values with a positive sum'"),
        ("operation <> 'replace' OR find <> ''", "'replace requires non-empty text or a regex to find'"),
        ("length(find) <= 4096", "'find/regex text is limited to 4,096 characters'"),
        ("octet_length(encode(replacement)) <= 1048576", "'replacement text is limited to 1 MiB'"),
        ("dry_run OR out_root IS NOT NULL", "'a real run requires an output folder'"),
    ],
    "audit": [
        ("hamming = floor(hamming)", "'near-duplicate Hamming threshold must be a whole number'"),
        ("min_side = floor(min_side)", "'minimum dimension must be a whole number'"),
        ("hash_side = floor(hash_side)", "'dHash size must be a whole number'"),
        ("hash_side BETWEEN 4 AND 32", "'dHash size must be between 4 and 32'"),
        ("hamming BETWEEN 0 AND hash_side * hash_side", "concat('near-duplicate Hamming threshold must be 0–', CAST(CAST(hash_side * hash_side AS BIGINT) AS STRING))"),
        ("oversized_mb > 0 AND oversized_mb <= 1000000", "'oversized threshold must be greater than 0 and at most 1,000,000 MB'"),
        ("min_side BETWEEN 1 AND 1000000", "'minimum dimension must be between 1 and 1,000,000 pixels'"),
    ],
    "extract": [
        ("depth = floor(depth) AND max_bytes = floor(max_bytes) AND max_file = floor(max_file) AND max_entries = floor(max_entries)", "'depth and resource limits must be whole numbers'"),
        ("depth BETWEEN 0 AND 2", "'nested depth must be between 0 and 2'"),
        ("max_bytes > 0 AND max_file > 0", "'archive and member byte limits must be positive'"),
        ("max_file <= max_bytes", "'per-member byte limit cannot exceed the archive byte limit'"),
        ("max_entries BETWEEN 1 AND 1000000", "'member-count limit must be between 1 and 1000000'"),
        ("collision IN ('rename', 'skip')", "'collision policy must be ''rename'' or ''skip'''"),
    ],
    "convert": [
        ("quality = floor(quality) AND fps = floor(fps) AND gif_width = floor(gif_width) AND dpi = floor(dpi)", "'quality, FPS, GIF width, and DPI must be whole numbers'"),
        ("target IN ('png', 'jpg', 'webp', 'bmp', 'tiff', 'ico', 'mp4', 'mov', 'mkv', 'webm', 'gif', 'mp3', 'wav', 'flac', 'aac', 'm4a', 'ogg', 'opus', 'html', 'pdf', 'txt', 'md')", "concat('unsupported target: ', CASE WHEN target = '' THEN '?' ELSE target END)"),
        ("quality BETWEEN 1 AND 100", "'JPEG/WebP quality must be between 1 and 100'"),
        ("fps BETWEEN 0 AND 240", "'frame rate must be between 0 and 240'"),
        ("gif_width BETWEEN 16 AND 8192", "'GIF width must be between 16 and 8192 pixels'"),
        ("dpi BETWEEN 36 AND 1200", "'PDF render DPI must be between 36 and 1200'"),
        ("MATCH(bitrate, '([1-9][0-9]{0,2}|10[01][0-9]|102[0-4])k')", "'audio bitrate must be between 1k and 1024k'"),
        ("trim(background) <> ''", "'flatten background colour is required'"),
        ("octet_length(encode(css)) <= 1048576", "'extra CSS must be text no larger than 1 MiB'"),
    ],
    "alpha": [
        ("method IN ('solid', 'chroma', 'edge_flood', 'ai')", "concat('unknown alpha method: ', method)"),
        ("method <> 'chroma' OR MATCH(key_colour, '#[0-9a-fA-F]{6}')", "'key colour must use #RRGGBB'"),
        (f"tolerance BETWEEN 0 AND {COLOUR_SPACE}", "'tolerance must be between 0 and 441.7'"),
        (f"band BETWEEN 0 AND {COLOUR_SPACE}", "'feather band must be between 0 and 441.7'"),
        ("feather BETWEEN 0 AND 100", "'defringe feather must be between 0 and 100'"),
        ("coverage BETWEEN 0 AND 1", "'minimum coverage must be between 0 and 1'"),
        whole("erode", 0, 32, "defringe erosion must be a whole number between 0 and 32"),
    ],
    "render": [
        ("kind IN ('sbs', 'mm')", "concat('unknown renderer kind: ', kind)"),
        ("trim(engine) <> ''", "'engine path is required'"),
        ("trim(input_dir) <> ''", "'input directory is required'"),
        ("trim(output_dir) <> ''", "'output directory is required'"),
        ("kind <> 'sbs' OR resolution IN ('512x512', '1024x1024', '2048x2048', '4096x4096')", "concat('unsupported Substance resolution: ', resolution)"),
        ("kind <> 'mm' OR target IN ('Unreal', 'Godot', 'Unity', 'Blender')", "concat('unsupported Material Maker target: ', target)"),
        ("resize IS NULL OR (resize = floor(resize) AND resize BETWEEN 16 AND 16384)", "'resize must be from 16 to 16384 pixels'"),
        whole("timeout", 1, 86400, "timeout must be from 1 to 86400 seconds"),
    ],
    "vector": [
        ("mode IN ('color', 'binary')", "concat('unsupported color mode: ', mode)"),
        ("hierarchy IN ('stacked', 'cutout')", "concat('unsupported hierarchy: ', hierarchy)"),
        whole("speckle", 0, 1_000_000, "filter speckle must be from 0 to 1000000"),
        whole("colours", 1, 8, "color precision must be from 1 to 8"),
        whole("digits", 0, 16, "path precision must be from 0 to 16"),
    ],
    "package": [
        ("has_assets", "'not a Unity project (no Assets folder)'"),
        ("n_includes > 0", "'Pick at least one folder to include.'"),
        ("collision IN ('error', 'overwrite', 'copy')", "concat('Unknown collision policy ', collision)"),
        ("level BETWEEN 0 AND 9", "'Compression level must be 0-9.'"),
        ("lower(output) LIKE '%.unitypackage'", "'Output file must end with .unitypackage.'"),
        ("include LIKE 'Assets/%' AND NOT include LIKE '%..%'", "concat(include, ' must be a folder or file inside Assets (not Assets itself).')"),
        ("NOT output LIKE concat(include, '/%')", "concat('The output file cannot be inside an included folder (', include, ').')"),
    ],
}


def sql(tool: str) -> str:
    """A CASE that gives the first broken rule's message, or null."""
    whens = []
    for condition, message in RULES[tool]:
        condition = re.sub(r"MATCH\((\w+), '((?:[^']|'')*)'\)", r"(\1 RLIKE '^(?:\2)$')", condition)
        condition = re.sub(r"encode\((\w+)\)", r"CAST(\1 AS BINARY)", condition).replace("\\.", "\\\\.")
        whens.append(f"WHEN NOT coalesce({condition}, FALSE) THEN {message}")
    return f"CASE {' '.join(whens)} END"


def problem(tool: str) -> Column:
    """The message of the first rule that a row of settings breaks; null for settings that meet all."""
    return F.expr(sql(tool))
