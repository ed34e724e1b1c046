"""Names of maps and files, what they can become, and whether settings are sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, options, textures
from .registry import dealt, numbered, query, sql_values, table

# File names made from the parts table: words in camel case, a map's word, at times a resolution.
WORDS = [w for all_ in textures.ROLE_WORDS.values() for w in all_] + ["mask", "detail"]
ENDS = ["", "_2k", "_DX", "-1024", "_raw_4k"]
STEM = f"replace(replace(replace(replace(p_name, ' ', '_'), '_r', 'R'), '_b', 'B'), '_g', 'G') || '_' || ({WORDS!r})[p_partkey % {len(WORDS)} + 1] || ({ENDS!r})[p_partkey % {len(ENDS)} + 1]"
STEMS = f"(SELECT p_partkey, {STEM} AS stem, ({WORDS!r})[p_partkey % {len(WORDS)} + 1] AS word FROM part)"


def stems(spark, sf_dir):
    name = F.col("p_name")
    for a, b in ((" ", "_"), ("_r", "R"), ("_b", "B"), ("_g", "G")):
        name = F.replace(name, F.lit(a), F.lit(b))
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(name, F.lit("_"), pick(WORDS), pick(ENDS)).alias("stem"))


WORD_LISTS = ", ".join(f"'{w}': '{role}'" for role, all_ in textures.ROLE_WORDS.items() for w in all_)
NO_END = r"regexp_replace(stem, '([_-](2k|4k|DX|raw|1024))+$', '')"


@query(
    f"""WITH r AS (SELECT p_partkey, stem, word, list_extract(map_extract(MAP {{{WORD_LISTS}}}, word), 1) AS role FROM {STEMS})
SELECT p_partkey, CASE WHEN role IS NULL THEN stem ELSE left({NO_END}, length({NO_END}) - length(word) - 1) END AS base, coalesce(role, 'unknown') AS role FROM r"""
)
def map_roles(spark, sf_dir):
    """Base name and role of each file name; qualifiers and resolutions behind the role's word do not matter."""
    base, role = textures.split_role(F.col("stem"))
    return stems(spark, sf_dir).select("p_partkey", base.alias("base"), role.alias("role"))


@query(
    f"""WITH r AS (SELECT p_partkey, stem, word, list_extract(map_extract(MAP {{{WORD_LISTS}}}, word), 1) AS role FROM {STEMS}), s AS (SELECT p_partkey, lower(left({NO_END}, length({NO_END}) - length(word) - 1)) AS base, role FROM r WHERE role IS NOT NULL),
f AS (SELECT base, role, min(p_partkey) AS k FROM s GROUP BY 1, 2) SELECT base, string_agg(role || '=' || k, ',' ORDER BY role) AS maps, count(*) AS n FROM f GROUP BY base"""
)
def texture_sets(spark, sf_dir):
    """The maps of each base name: the first file of each role."""
    base, role = textures.split_role(F.col("stem"))
    files = stems(spark, sf_dir).select(F.lower(base).alias("base"), role.alias("role"), "p_partkey").where("role != 'unknown'")
    first = files.groupBy("base", "role").agg(F.min("p_partkey").alias("k"))
    maps = F.transform(F.array_sort(F.collect_list(F.struct("role", "k"))), lambda m: F.concat_ws("=", m["role"], m["k"].cast("string")))  # eight roles at most
    return first.groupBy("base").agg(F.array_join(maps, ",").alias("maps"), F.count("*").alias("n"))


@query(f"SELECT p_partkey, array_to_string(regexp_extract_all(regexp_replace(stem, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), ' ') AS tokens FROM (SELECT p_partkey, replace(stem, 'DX', 'dx') AS stem FROM {STEMS})")
def map_tokens(spark, sf_dir):
    spans = textures.token_spans(F.replace("stem", F.lit("DX"), F.lit("dx")))
    return stems(spark, sf_dir).select("p_partkey", F.array_join(F.transform(spans, lambda s: s["token"]), " ").alias("tokens"))


ENGINES = ["none", "unity", "unreal", "godot", "blender", "gltf"]
NAME_ROWS = [(e, r, (textures.ROLE_NAMES | textures.ENGINE_NAMES.get(e, {})).get(r, r.capitalize())) for e in ENGINES for r in [*textures.ROLE_NAMES, "mask"]]


ROLES = [*textures.ROLE_NAMES, "mask"]


@query(f"SELECT p_partkey, engine, role, replace(p_name, ' ', '') || '_' || suffix AS file FROM part JOIN {numbered(NAME_ROWS, 'engine, role, suffix')} ON i = p_partkey % {len(NAME_ROWS)}")
def engine_names(spark, sf_dir):
    """What a part's map of each role is called for each engine."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", dealt([e for e, _, _ in NAME_ROWS], "p_partkey").alias("engine"), dealt([r for _, r, _ in NAME_ROWS], "p_partkey").alias("role"))
    suffix = F.coalesce(*[F.when(F.col("engine") == e, textures.engine_suffix(F.col("role"), e)) for e in ENGINES])
    return rows.select("p_partkey", "engine", "role", F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("_"), suffix).alias("file"))


RES = "(" + "|".join(textures.RESOLUTIONS) + ")"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(lower(stem), '[_. -]{RES}$') THEN regexp_replace(left(stem, length(stem) - length(regexp_extract(lower(stem), '{RES}$', 1))), '[_. -]+$', '') ELSE stem END AS clean, CASE WHEN regexp_matches(lower(stem), '[_. -]{RES}$') THEN regexp_extract(lower(stem), '{RES}$', 1) ELSE '' END AS resolution FROM {STEMS}")
def resolution_split(spark, sf_dir):
    clean, resolution = textures.split_resolution(F.col("stem"))
    return stems(spark, sf_dir).select("p_partkey", clean.alias("clean"), resolution.alias("resolution"))


CLEAN = f"(SELECT p_partkey, CASE WHEN regexp_matches(lower(stem), '[_. -]{RES}$') THEN regexp_replace(left(stem, length(stem) - length(regexp_extract(lower(stem), '{RES}$', 1))), '[_. -]+$', '') ELSE stem END AS c FROM {STEMS})"
BASES, OTHERS = "|".join(textures.BASE_TOKENS), "|".join(textures.OTHER_MAPS)


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(lower(c), '[_. -]({BASES})$') THEN regexp_replace(c, '(?i)[_. -]+({BASES})$', '') WHEN regexp_matches(lower(c), '[a-z0-9]({"|".join(textures.GLUED)})$') THEN regexp_replace(c, '(?i)({"|".join(textures.GLUED)})$', '') END AS set_name,
regexp_matches(lower(c), '(^|[_. -])({OTHERS})$') AS secondary FROM {CLEAN}"""
)
def set_names(spark, sf_dir):
    """The set that a base map names, and whether a file is another map of a set."""
    return stems(spark, sf_dir).select("p_partkey", textures.base_split(F.col("stem")).alias("set_name"), textures.is_secondary(F.col("stem")).alias("secondary"))


PAIRS = [(k, t) for k, all_ in textures.TARGETS.items() for t in sorted(set(all_))]


KINDS = [*textures.TARGETS, "none"]


@query(f"WITH t AS (SELECT kind, string_agg(target, ',' ORDER BY target) AS targets, count(*) AS n FROM {sql_values(PAIRS, 'kind, target')} GROUP BY kind) SELECT p_partkey, k.kind, coalesce(targets, '') AS targets, coalesce(n, 0) AS n FROM part JOIN {numbered([(k,) for k in KINDS], 'kind').replace('AS t(', 'AS k(')} ON k.i = p_partkey % {len(KINDS)} LEFT JOIN t ON t.kind = k.kind")
def conversion_targets(spark, sf_dir):
    """What a file of each kind can become."""
    found = textures.kind_targets(F.col("kind"))
    kinds = table(spark, sf_dir, "part").select("p_partkey", dealt(KINDS, "p_partkey").alias("kind"))
    return kinds.select("p_partkey", "kind", F.array_join(found, ",").alias("targets"), F.size(found).cast("long").alias("n"))


HOW = "CASE kind WHEN 'image' THEN 'picture' WHEN 'gif' THEN CASE WHEN target IN ('mp4', 'mov', 'mkv', 'webm') THEN 'film' ELSE 'picture' END WHEN 'video' THEN CASE WHEN target = 'gif' THEN 'film to gif' WHEN target IN ('mp4', 'mov', 'mkv', 'webm') THEN 'film' ELSE 'sound of film' END WHEN 'audio' THEN 'sound' WHEN 'pdf' THEN CASE WHEN target IN ('png', 'jpg') THEN 'pages' ELSE 'document' END ELSE 'document' END"


ASKED = [*PAIRS, ("pdf", "mp3")]


@query(f"SELECT p_partkey, kind, target, CASE WHEN kind = 'pdf' AND target = 'mp3' THEN NULL ELSE {HOW} END AS how FROM part JOIN {numbered(ASKED, 'kind, target')} ON i = p_partkey % {len(ASKED)}")
def conversion_dispatch(spark, sf_dir):
    """By which way a file of one kind becomes one of another."""
    pairs = table(spark, sf_dir, "part").select("p_partkey", dealt([k for k, _ in ASKED], "p_partkey").alias("kind"), dealt([t for _, t in ASKED], "p_partkey").alias("target"))
    return pairs.select("p_partkey", "kind", "target", textures.converter(F.col("kind"), F.col("target")).alias("how"))


HEADS = [("89504E470D0A1A0A0000", ".png"), ("FFD8FFE000104A464946", ".JPG"), ("474946383961", ".gif"), ("52494646AAAAAAAA57454250", ".png"), ("424D36", ".bmp"), ("49492A0008", ".tif"), ("4D4D002A", ".tiff"), ("3C68746D6C3E", ".png"), ("", ".gif"), ("52494646AAAAAAAA57415645", ".webp")]


@query(
    f"""SELECT p_partkey, head, CASE WHEN starts_with(head, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(head, 'FFD8FF') THEN 'jpeg' WHEN starts_with(head, '474946383761') OR starts_with(head, '474946383961') THEN 'gif'
WHEN starts_with(head, '52494646') AND substring(head, 17, 8) = '57454250' THEN 'webp' WHEN starts_with(head, '424D') THEN 'bmp' WHEN starts_with(head, '49492A00') OR starts_with(head, '4D4D002A') THEN 'tiff' END AS format,
CASE lower(suffix) WHEN '.png' THEN 'png' WHEN '.jpg' THEN 'jpeg' WHEN '.gif' THEN 'gif' WHEN '.bmp' THEN 'bmp' WHEN '.webp' THEN 'webp' ELSE 'tiff' END AS expected FROM (SELECT p_partkey, h.head || CASE WHEN h.head = '' THEN '' ELSE printf('%02X', p_partkey % 200) END AS head, s.suffix FROM part JOIN {numbered(HEADS, 'head, suffix').replace('AS t(', 'AS h(')} ON h.i = p_partkey % {len(HEADS)} JOIN {numbered(HEADS, 'head, suffix').replace('AS t(', 'AS s(')} ON s.i = p_size % {len(HEADS)})"""
)
def picture_signatures(spark, sf_dir):
    """The format that a file's first bytes show against the one its suffix promises."""
    last = F.format_string("%02X", F.col("p_partkey") % 200)
    rows = table(spark, sf_dir, "part").select("p_partkey", dealt([h for h, _ in HEADS], "p_partkey").alias("h"), dealt([x for _, x in HEADS], "p_size").alias("suffix"))
    rows = rows.withColumn("head", F.concat("h", F.when(F.col("h") == "", "").otherwise(last)))
    return rows.select("p_partkey", "head", textures.picture_format(F.unhex("head")).alias("format"), textures.expected_format(F.col("suffix")).alias("expected"))


NAMES = [("a.unitypackage",), ("b.ZIP",), ("c.tar.gz",), ("d.gz",), ("e.bz2",), ("f.tar.xz",), ("g.txz",), ("h.png",), ("zip",)]


@query(f"SELECT p_partkey, name, CASE WHEN lower(name) LIKE '%.unitypackage' THEN 'unity' WHEN lower(name) LIKE '%.zip' THEN 'zip' WHEN regexp_matches(lower(name), '\\.(tar|tar\\.gz|tgz|tar\\.bz2|tbz2|tar\\.xz|txz|gz)$') THEN 'tar' END AS kind FROM (SELECT p_partkey, replace(p_name, ' ', '.') || name AS name FROM part JOIN {numbered(NAMES, 'name')} ON i = p_partkey % {len(NAMES)})")
def archive_kinds(spark, sf_dir):
    """Which archives files are by their names."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), dealt([n for (n,) in NAMES], "p_partkey")).alias("name"))
    return rows.select("p_partkey", "name", textures.archive_kind(F.col("name")).alias("kind"))


FORMATS = ["mp3", "wav", "flac", "aac", "m4a", "ogg", "opus", "xyz"]
MUX = "CASE t WHEN 'aac' THEN 'adts' WHEN 'm4a' THEN 'ipod' WHEN 'xyz' THEN NULL ELSE t END"


@query(
    f"""WITH e AS (SELECT event_id, ({FORMATS!r})[event_id % 8 + 1] AS t, coalesce(value, 0) AS v, event_type FROM events)
SELECT event_id, {MUX} AS muxer, CASE WHEN t = 'mp3' THEN 're-encode mp3' ELSE 'convert→' || t END || CASE WHEN event_type = 'view' THEN ', trim' ELSE '' END || CASE WHEN v > 50 THEN ', fade' ELSE '' END || CASE WHEN event_type = 'error' THEN ', normalize' ELSE '' END AS steps FROM e"""
)
def sound_plans(spark, sf_dir):
    """Container and work in words for each event taken as a sound job."""
    pick = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick.alias("t"), F.coalesce("value", F.lit(0.0)).alias("v"), "event_type")
    start = F.when(F.col("event_type") == "view", "0:05").otherwise(" ")
    steps = textures.describe_sound(F.lit(".MP3"), F.col("t"), start, F.lit(""), F.when(F.col("v") > 50, 1.0).otherwise(0.0), F.lit(None).cast("double"), F.col("event_type") == "error")
    return rows.select("event_id", textures.muxer(F.concat(F.lit("."), F.col("t"))).alias("muxer"), steps.alias("steps"))


LABELS = ["512x512", "1024x1024", "2048x2048", "4096x4096", "13x13"]


@query(
    f"""WITH p AS (SELECT p_partkey, ({LABELS!r})[p_partkey % 5 + 1] AS label FROM part), q AS (SELECT p_partkey, CASE label WHEN '512x512' THEN '9,9' WHEN '2048x2048' THEN '11,11' WHEN '4096x4096' THEN '12,12' ELSE '10,10' END AS size FROM p)
SELECT p_partkey, size, 'sbsrender render --inputs p' || p_partkey || '.sbsar --output-path out --output-name {{inputName}}_{{outputNodeName}} --set-value $outputsize@' || size AS first,
'material_maker --export-material --target Godot -o out p' || p_partkey || '.ptex' AS second FROM q"""
)
def renderer_commands(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", textures.power_pair(label).alias("size"))
    name = lambda suffix: F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(suffix))
    first = textures.renderer_arguments(F.lit("sbsrender"), name(".sbsar"), F.lit("out"), size=F.col("size"))
    second = textures.renderer_arguments(F.lit("material_maker"), name(".ptex"), F.lit("out"), target=F.lit("Godot"))
    return rows.select("p_partkey", "size", F.array_join(first, " ").alias("first"), F.array_join(second, " ").alias("second"))


PATHS = [("/opt/sbsrender", True), ("/opt/SBSRender.exe", True), ("/opt/render", True), ("/opt/sbsrender.sh", False), ("  ", False), (None, False)]


@query(f"SELECT p_partkey, path, CASE WHEN coalesce(trim(path), '') = '' OR NOT there THEN 'engine.missing' WHEN NOT regexp_matches(lower(path), '/sbsrender(\\.[^./]*)?$') THEN 'engine.wrong' END AS problem FROM (SELECT p_partkey, '/parts/' || p_size || path AS path, there FROM part JOIN {numbered(PATHS, 'path, there')} ON i = p_partkey % {len(PATHS)})")
def engine_checks(spark, sf_dir):
    """Whether a renderer is there and is one."""
    path = F.concat(F.lit("/parts/"), F.col("p_size").cast("string"), dealt([x for x, _ in PATHS], "p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), dealt([t for _, t in PATHS], "p_partkey").alias("there"))
    return rows.select("p_partkey", "path", textures.engine_problem(F.col("path"), F.col("there"), "sbsrender").alias("problem"))


@query("SELECT p_partkey, concat_ws(',', least(255, CAST(floor(p_size * 1.5::DOUBLE) AS INTEGER)), least(255, CAST(floor((p_partkey % 256) * 1.5::DOUBLE) AS INTEGER)), 255) AS colour FROM part")
def shades(spark, sf_dir):
    parts = [F.col("p_size"), F.col("p_partkey") % 256, F.lit(200)]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(textures.shade(parts, 1.5).cast("array<string>"), ",").alias("colour"))


GLYPH_ROWS = [*[(n, c) for n, c in media.GLYPHS.items()], ("A", "A"), ("cap_b", "B"), ("small_C", "c"), ("uni00E9", "é"), ("0x0041", "A"), ("nothing", None)]


@query(f"SELECT p_partkey, name, glyph FROM part JOIN {numbered(GLYPH_ROWS, 'name, glyph')} ON i = p_partkey % {len(GLYPH_ROWS)}")
def glyph_names(spark, sf_dir):
    """The character that a picture's name stands for."""
    rows = table(spark, sf_dir, "part").select("p_partkey", dealt([n for n, _ in GLYPH_ROWS], "p_partkey").alias("name"))
    return rows.select("p_partkey", "name", media.glyph(F.col("name")).alias("glyph"))


SUFFIXES = [(s, kind) for kind, all_ in media.KINDS.items() for s in all_] + [(".XYZ", "")]


@query(f"SELECT p_partkey, suffix, kind FROM part JOIN {numbered(SUFFIXES, 'suffix, kind')} ON i = p_partkey % {len(SUFFIXES)}")
def source_kinds(spark, sf_dir):
    """What kind of source a suffix names, in either case."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", dealt([x for x, _ in SUFFIXES], "p_partkey").alias("suffix"))
    return rows.select("p_partkey", "suffix", media.source_kind(F.when(F.col("p_size") % 2 == 0, F.upper("suffix")).otherwise(F.col("suffix"))).alias("kind"))


@query(
    """WITH e AS (SELECT event_id, value AS actual, CAST(user_id % 40 AS DOUBLE) AS expected FROM events WHERE value IS NOT NULL)
SELECT event_id, actual >= greatest(0.01, least(expected * 0.25, 0.25)) AND actual <= expected + greatest(1.0, expected * 0.5) AS plausible FROM e"""
)
def plausible_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "value", (F.col("user_id") % 40).cast("double").alias("expected"))
    return rows.select("event_id", media.plausible_length(F.col("value"), F.col("expected")).alias("plausible"))


# Settings made from the driver tables, so that every rule is both kept and broken.
SETTINGS = {
    "dataset": ("SELECT p_partkey AS k, CASE p_size % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'pair_report' WHEN 2 THEN 'bucket' WHEN 3 THEN 'split' WHEN 4 THEN 'replace' ELSE 'other' END AS operation, CASE WHEN p_size % 11 = 0 THEN 'x' ELSE 'aspect' END AS bucket_mode, p_size % 18 AS n_exts, CASE WHEN p_size % 7 = 0 THEN 'txt' ELSE '.txt,.caption' END AS exts, CAST(p_size AS DOUBLE) - 3 AS train, 0.0 AS val, 0.1 AS test, CASE WHEN p_size > 40 THEN '' ELSE p_name END AS find, p_type AS replacement, p_size % 2 = 0 AS dry_run, CASE WHEN p_size % 3 = 0 THEN 'out' END AS out_root FROM part"),
    "audit": ("SELECT p_partkey AS k, CAST(p_size * 3 AS DOUBLE) - 4 AS hamming, CAST(p_size AS DOUBLE) / 2 AS hash_side, CAST(p_partkey % 9 AS DOUBLE) - 1 AS min_side, p_retailprice - 920 AS oversized_mb FROM part"),
    "extract": ("SELECT p_partkey AS k, CAST(p_size % 4 AS DOUBLE) AS depth, CAST(p_size * 100 AS DOUBLE) - 200 AS max_bytes, CAST(p_partkey AS DOUBLE) AS max_file, CAST(p_size % 5 AS DOUBLE) / 2 AS max_entries, CASE WHEN p_partkey % 3 = 0 THEN 'keep' ELSE 'rename' END AS collision FROM part"),
    "convert": ("SELECT p_partkey AS k, CAST(p_size * 3 AS DOUBLE) AS quality, CAST(p_partkey % 300 AS DOUBLE) AS fps, CAST(p_partkey % 97 AS DOUBLE) AS gif_width, CAST(p_partkey % 1500 AS DOUBLE) AS dpi, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'exe' ELSE 'png' END AS target, concat(CAST(p_partkey % 1200 AS VARCHAR), 'k') AS bitrate, CASE WHEN p_size = 7 THEN ' ' ELSE '#fff' END AS background, p_type AS css FROM part"),
    "alpha": ("SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'magic' WHEN 1 THEN 'chroma' WHEN 2 THEN 'ai' ELSE 'solid' END AS method, CASE WHEN p_partkey % 2 = 0 THEN '#00FF00' ELSE 'green' END AS key_colour, p_retailprice - 900 AS tolerance, CAST(p_size * 10 AS DOUBLE) AS band, CAST(p_partkey % 150 AS DOUBLE) AS feather, CAST(p_size AS DOUBLE) / 40 AS coverage, CAST(p_size AS DOUBLE) AS erode FROM part"),
    "render": ("SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'sbs' WHEN 1 THEN 'mm' ELSE CASE WHEN p_size > 25 THEN 'mm' ELSE 'x' END END AS kind, CASE WHEN p_size = 4 THEN ' ' ELSE 'e' END AS engine, 'i' AS input_dir, CASE WHEN p_size = 9 THEN '' ELSE 'o' END AS output_dir, CASE WHEN p_partkey % 2 = 0 THEN '512x512' ELSE '1x1' END AS resolution, CASE WHEN p_partkey % 3 = 0 THEN 'Godot' ELSE 'Maya' END AS target, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS resize, CAST(p_partkey % 7 AS DOUBLE) / 2 AS timeout FROM part"),
    "vector": ("SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 'grey' ELSE 'color' END AS mode, CASE WHEN p_size % 5 = 0 THEN 'flat' ELSE 'stacked' END AS hierarchy, CAST(p_partkey AS DOUBLE) - 50 AS speckle, CAST(p_size % 11 AS DOUBLE) AS colours, CAST(p_size AS DOUBLE) / 2 AS digits FROM part"),
    "package": ("SELECT p_partkey AS k, p_size > 2 AS has_assets, p_size % 7 AS n_includes, CASE WHEN p_size % 9 = 0 THEN 'merge' ELSE 'copy' END AS collision, p_partkey % 12 AS level, CASE p_partkey % 5 WHEN 0 THEN 'a.zip' WHEN 1 THEN 'Assets/Red/a.unitypackage' ELSE 'a.UnityPackage' END AS output, CASE p_partkey % 4 WHEN 0 THEN 'Assets' WHEN 1 THEN 'Assets/../x' ELSE 'Assets/Red' END AS include FROM part"),
}


# What each tool says of its settings, written out by itself: what is wrong, in the order in which it is looked for.
OBJECTIONS = {
    "dataset": """CASE WHEN NOT list_contains(['pair_report', 'replace', 'bucket', 'split'], operation) THEN 'unknown operation: ' || operation WHEN bucket_mode <> 'dimensions' AND bucket_mode <> 'aspect' THEN 'unknown bucket mode: ' || bucket_mode
      WHEN n_exts < 1 OR n_exts > 16 THEN 'provide between 1 and 16 caption extensions' WHEN len(list_filter(string_split(ltrim(exts, ','), ','), lambda x: NOT regexp_matches(x, '^\\.[a-z0-9][a-z0-9_-]{0,15}$'))) > 0 THEN 'caption extensions must be unique safe suffixes such as .txt'
      WHEN least(train, val, test) < 0 OR train + val + test <= 0 THEN 'split ratios must be three finite non-negative values with a positive sum' WHEN operation = 'replace' AND length(find) = 0 THEN 'replace requires non-empty text or a regex to find'
      WHEN length(find) > 4096 THEN 'find/regex text is limited to 4,096 characters' WHEN strlen(replacement) > 1024 * 1024 THEN 'replacement text is limited to 1 MiB' WHEN NOT dry_run AND out_root IS NULL THEN 'a real run requires an output folder' END""",
    "audit": """CASE WHEN hamming % 1 <> 0 THEN 'near-duplicate Hamming threshold must be a whole number' WHEN min_side % 1 <> 0 THEN 'minimum dimension must be a whole number' WHEN hash_side % 1 <> 0 THEN 'dHash size must be a whole number'
      WHEN hash_side < 4 OR hash_side > 32 THEN 'dHash size must be between 4 and 32' WHEN hamming < 0 OR hamming > hash_side ** 2 THEN 'near-duplicate Hamming threshold must be 0–' || CAST(hash_side ** 2 AS INTEGER)
      WHEN oversized_mb <= 0 OR oversized_mb > 1e6 THEN 'oversized threshold must be greater than 0 and at most 1,000,000 MB' WHEN min_side < 1 OR min_side > 1e6 THEN 'minimum dimension must be between 1 and 1,000,000 pixels' END""",
    "extract": """CASE WHEN depth % 1 + max_bytes % 1 + max_file % 1 + max_entries % 1 <> 0 THEN 'depth and resource limits must be whole numbers' WHEN depth NOT IN (0, 1, 2) THEN 'nested depth must be between 0 and 2'
      WHEN least(max_bytes, max_file) <= 0 THEN 'archive and member byte limits must be positive' WHEN max_bytes < max_file THEN 'per-member byte limit cannot exceed the archive byte limit' WHEN max_entries < 1 OR max_entries > 1000000 THEN 'member-count limit must be between 1 and 1000000'
      WHEN collision <> 'rename' AND collision <> 'skip' THEN 'collision policy must be ' || chr(39) || 'rename' || chr(39) || ' or ' || chr(39) || 'skip' || chr(39) END""",
    "convert": """CASE WHEN quality % 1 + fps % 1 + gif_width % 1 + dpi % 1 <> 0 THEN 'quality, FPS, GIF width, and DPI must be whole numbers'
      WHEN NOT list_contains(string_split('png jpg webp bmp tiff ico mp4 mov mkv webm gif mp3 wav flac aac m4a ogg opus html pdf txt md', ' '), target) THEN 'unsupported target: ' || coalesce(nullif(target, ''), '?') WHEN quality < 1 OR quality > 100 THEN 'JPEG/WebP quality must be between 1 and 100'
      WHEN fps < 0 OR fps > 240 THEN 'frame rate must be between 0 and 240' WHEN gif_width < 16 OR gif_width > 8192 THEN 'GIF width must be between 16 and 8192 pixels' WHEN dpi < 36 OR dpi > 1200 THEN 'PDF render DPI must be between 36 and 1200'
      WHEN coalesce(TRY_CAST(rtrim(bitrate, 'k') AS INTEGER), 0) NOT BETWEEN 1 AND 1024 OR bitrate LIKE '0%' THEN 'audio bitrate must be between 1k and 1024k' WHEN replace(background, ' ', '') = '' THEN 'flatten background colour is required' WHEN strlen(css) > 1024 * 1024 THEN 'extra CSS must be text no larger than 1 MiB' END""",
    "alpha": """CASE WHEN NOT list_contains(['solid', 'chroma', 'edge_flood', 'ai'], method) THEN 'unknown alpha method: ' || method WHEN method = 'chroma' AND NOT (length(key_colour) = 7 AND starts_with(key_colour, '#') AND TRY_CAST('0x' || substring(key_colour, 2) AS INTEGER) IS NOT NULL) THEN 'key colour must use #RRGGBB'
      WHEN tolerance < 0 OR tolerance > sqrt(3 * 255.0 * 255.0) THEN 'tolerance must be between 0 and 441.7' WHEN band < 0 OR band > sqrt(3 * 255.0 * 255.0) THEN 'feather band must be between 0 and 441.7' WHEN feather < 0 OR feather > 100 THEN 'defringe feather must be between 0 and 100'
      WHEN coverage < 0 OR coverage > 1 THEN 'minimum coverage must be between 0 and 1' WHEN erode % 1 <> 0 OR erode < 0 OR erode > 32 THEN 'defringe erosion must be a whole number between 0 and 32' END""",
    "render": """CASE WHEN kind <> 'sbs' AND kind <> 'mm' THEN 'unknown renderer kind: ' || kind WHEN replace(engine, ' ', '') = '' THEN 'engine path is required' WHEN replace(input_dir, ' ', '') = '' THEN 'input directory is required' WHEN replace(output_dir, ' ', '') = '' THEN 'output directory is required'
      WHEN kind = 'sbs' AND resolution NOT IN (SELECT n || 'x' || n FROM (VALUES (512), (1024), (2048), (4096)) t(n)) THEN 'unsupported Substance resolution: ' || resolution WHEN kind = 'mm' AND NOT list_contains(['Unreal', 'Godot', 'Unity', 'Blender'], target) THEN 'unsupported Material Maker target: ' || target
      WHEN resize % 1 <> 0 OR resize < 16 OR resize > 16384 THEN 'resize must be from 16 to 16384 pixels' WHEN timeout % 1 <> 0 OR timeout < 1 OR timeout > 24 * 3600 THEN 'timeout must be from 1 to 86400 seconds' END""",
    "vector": """CASE WHEN mode <> 'color' AND mode <> 'binary' THEN 'unsupported color mode: ' || mode WHEN hierarchy <> 'stacked' AND hierarchy <> 'cutout' THEN 'unsupported hierarchy: ' || hierarchy WHEN speckle % 1 <> 0 OR speckle < 0 OR speckle > 1e6 THEN 'filter speckle must be from 0 to 1000000'
      WHEN colours NOT IN (1, 2, 3, 4, 5, 6, 7, 8) THEN 'color precision must be from 1 to 8' WHEN digits % 1 <> 0 OR digits < 0 OR digits > 16 THEN 'path precision must be from 0 to 16' END""",
    "package": """CASE WHEN NOT has_assets THEN 'not a Unity project (no Assets folder)' WHEN n_includes < 1 THEN 'Pick at least one folder to include.' WHEN NOT list_contains(['error', 'overwrite', 'copy'], collision) THEN 'Unknown collision policy ' || collision WHEN level < 0 OR level > 9 THEN 'Compression level must be 0-9.'
      WHEN NOT regexp_matches(output, '(?i)\\.unitypackage$') THEN 'Output file must end with .unitypackage.' WHEN NOT starts_with(include, 'Assets/') OR contains(include, '..') THEN include || ' must be a folder or file inside Assets (not Assets itself).' WHEN starts_with(output, include || '/') THEN 'The output file cannot be inside an included folder (' || include || ').' END""",
}


@query(" UNION ALL ".join(f"SELECT '{tool}' AS tool, k, {OBJECTIONS[tool]} AS problem FROM ({rows})" for tool, rows in SETTINGS.items()))
def option_problems(spark, sf_dir):
    """The first broken rule of each tool's settings."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    out = None
    for tool, rows in SETTINGS.items():
        part = spark.sql(rows.replace("AS VARCHAR", "AS STRING")).select(F.lit(tool).alias("tool"), "k", options.problem(tool).alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


PLACES = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/in/a/b/p' WHEN 1 THEN '/in/p' ELSE '/other/p' END || page_id || '.jpeg' AS path FROM pages"


@query(
    f"""WITH p AS (SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM ({PLACES}))
SELECT page_id, CASE WHEN starts_with(path, '/in/') THEN '/out' || substring(folder, 4) || '/' || stem || '.png' ELSE '/out/' || stem || '.png' END AS mirror, '/out/' || stem || '.png' AS flat, folder || '/done/' || stem || '.png' AS beside,
CASE WHEN starts_with(path, '/in/') THEN '/out' || substring(folder, 4) || '/' || stem ELSE '/out/' || stem END AS clips FROM p"""
)
def planned_outputs(spark, sf_dir):
    """Where results go, by each of the ways to place them, and the folder of a file's clips."""
    from ..functions.names import planned_output

    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    rows = spark.sql(PLACES.replace("|| page_id ||", "|| CAST(page_id AS STRING) ||"))
    path, png = F.col("path"), F.lit(".png")
    return rows.select(
        "page_id", planned_output(path, F.lit("/in"), F.lit("/out"), "mirror", png).alias("mirror"), planned_output(path, F.lit("/in"), F.lit("/out"), "flat", png).alias("flat"),
        planned_output(path, F.lit("/in"), F.lit("done"), "sibling", png).alias("beside"), planned_output(path, F.lit("/in"), F.lit("/out"), "mirror", F.lit("")).alias("clips"),
    )
