"""Names of texture files: tokens, map roles, resolutions, sets; targets and arguments of conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import KINDS, lookup

# Words that name a map, by role.
ROLE_WORDS = {
    "basecolor": ["basecolor", "base", "albedo", "alb", "diffuse", "diff", "color", "colour", "col", "basemap"],
    "normal": ["normal", "normals", "nrm", "norm", "nor", "normalmap"],
    "roughness": ["roughness", "rough", "rgh", "roughnessmap"],
    "gloss": ["gloss", "glossiness", "glossy"],
    "metallic": ["metallic", "metalness", "metallness", "metalic", "metal", "mtl", "met"],
    "ao": ["ao", "ambientocclusion", "occlusion", "occ", "aomap"],
    "height": ["height", "heightmap", "disp", "displacement", "bump"],
    "orm": ["orm", "rma", "arm", "maskmap"],
}
# Trailing words that say nothing of the role.
QUALIFIERS = ["dx", "gl", "ogl", "opengl", "directx", "raw", "srgb", "linear", "lin", "1k", "2k", "4k", "8k", "512", "1024", "2048", "4096", "hq", "lq", "map"]
# The neutral name of each role, and what engines call it otherwise.
ROLE_NAMES = {"basecolor": "BaseColor", "normal": "Normal", "roughness": "Roughness", "gloss": "Gloss", "metallic": "Metallic", "ao": "AO", "height": "Height", "orm": "ORM"}
ENGINE_NAMES = {
    "unity": {"ao": "Occlusion"},
    "godot": {"basecolor": "Albedo"},
    "gltf": {"basecolor": "baseColor", "normal": "normal", "roughness": "roughness", "gloss": "gloss", "metallic": "metallic", "ao": "occlusion", "height": "height"},
}
# Fixed values of set names: separators, base tokens (longest first), those that may be glued on, other maps, resolutions.
SEPARATORS = "_- ."
BASE_TOKENS = ["basecolor", "base_color", "base-color", "basemap", "base_map", "albedo", "diffuse", "colour", "color", "diff", "col", "bc"]
GLUED = ["basecolor", "basemap", "albedo", "diffuse"]
OTHER_MAPS = [
    "normal", "nrm", "nor", "roughness", "rough", "height", "displacement", "disp", "ao", "ambientocclusion", "occlusion", "metallic", "metalness", "metal", "orm", "rma", "arm",
    "emission", "emissive", "opacity", "alpha", "specular", "gloss", "glossiness", "smoothness", "bump", "translucency",
]
RESOLUTIONS = ["1k", "2k", "4k", "8k", "16k", "1024", "2048", "4096", "8192", "uhd", "hdr", "fhd"]
# Fixed value: a token begins at a capital or behind anything that is no letter or digit.
TOKEN = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
MARK = "\x01"


def token_spans(stem: Column) -> Column:
    """Tokens with their places: an array of (token, start, end), from 0."""
    marked = F.split(F.regexp_replace(stem, f"({TOKEN})", f"{MARK}$1"), MARK)
    ends = F.transform(marked, lambda part, i: F.length(F.array_join(F.slice(marked, 1, i), "")))
    tokens = F.regexp_extract_all(stem, F.lit(f"({TOKEN})"))
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(ends, i + 1).alias("start"), (F.get(ends, i + 1) + F.length(t)).alias("end")))


def split_role(stem: Column) -> tuple[Column, Column]:
    """(base, role): behind qualifiers and numbers, the longest run of up to three tokens that names a role; the base is
    the text before it. (stem, 'unknown') where there is none."""
    tokens = F.transform(F.regexp_extract_all(stem, F.lit(f"({TOKEN})")), F.lower)
    plain = F.transform(tokens, lambda t, i: F.when(~t.isin(QUALIFIERS) & ~t.rlike("^[0-9]+$"), i + 1))
    end = F.when(F.size(tokens) > 0, F.coalesce(F.array_max(plain), F.lit(1)))
    words = {w: role for role, all_ in ROLE_WORDS.items() for w in all_}
    base, role = stem, F.lit("unknown")
    for n in (1, 2, 3):
        start = end - n  # tokens before the run
        found = F.when(start >= 0, lookup(F.array_join(F.slice(tokens, F.greatest(start, F.lit(0)) + 1, n), ""), words))
        before = F.regexp_replace(F.translate(F.call_function("substring_index", F.regexp_replace(stem, f"({TOKEN})", f"{MARK}$1"), F.lit(MARK), start + 1), MARK, ""), "[ _.-]+$", "")
        base = F.when(found.isNotNull(), F.when(before == "", stem).otherwise(before)).otherwise(base)
        role = F.coalesce(found, role)
    return base, role


def engine_suffix(role: Column, engine: str) -> Column:
    """What an engine calls a role; the neutral name for engines without names of their own, else the role capitalised."""
    names = ROLE_NAMES | ENGINE_NAMES.get(engine, {})
    return F.coalesce(lookup(role, names), F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1 << 30))))


def one_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def split_resolution(stem: Column) -> tuple[Column, Column]:
    """(stem without a trailing resolution, the resolution in lower case or ''); only behind a separator."""
    pattern = rf"(?i)^(.*?)[_\- .]+({one_of(RESOLUTIONS)})$"
    has = stem.rlike(pattern)
    return F.when(has, F.regexp_extract(stem, pattern, 1)).otherwise(stem), F.when(has, F.lower(F.regexp_extract(stem, pattern, 2))).otherwise(F.lit(""))


def base_split(stem: Column) -> Column:
    """The set's name where the stem ends in a base token behind a separator, or in one that may be glued on: '' for the
    token alone, null where it does not."""
    clean = split_resolution(stem)[0]
    apart = rf"(?i)^(?:(.*?)[_\- .]+)?{one_of(BASE_TOKENS)}$"
    glued = rf"(?i)^(.*[\p{{L}}\p{{N}}]){one_of(GLUED)}$"
    return F.when(clean.rlike(apart), F.regexp_extract(clean, apart, 1)).when(clean.rlike(glued), F.regexp_extract(clean, glued, 1))


def is_secondary(stem: Column) -> Column:
    """Whether the stem ends in a map's token other than a base one, at a separator or alone."""
    return split_resolution(stem)[0].rlike(rf"(?i)(?:^|[_\- .]){one_of(OTHER_MAPS)}$")


# The formats that each kind of file can become.
SOUNDS, FILMS, PICTURES = ["mp3", "wav", "flac", "aac", "m4a"], ["mp4", "mov", "mkv", "webm"], ["png", "jpg", "webp", "bmp", "tiff", "ico"]
TARGETS = {
    "image": PICTURES, "gif": PICTURES + FILMS, "video": [*FILMS, "gif", *SOUNDS], "audio": [*SOUNDS, "ogg", "opus"],
    "markdown": ["html", "pdf"], "html": ["pdf"], "docx": ["html", "pdf"], "pdf": ["png", "jpg", "txt", "md"],
}
FOLDER_TARGETS = [("pdf", "png"), ("pdf", "jpg")]
# Containers by suffix, sizes as powers of two, first bytes of picture formats, the format of a suffix.
MUXERS = {".mp3": "mp3", ".wav": "wav", ".flac": "flac", ".aac": "adts", ".m4a": "ipod", ".ogg": "ogg", ".opus": "opus"}
POWERS = {"512x512": "9,9", "1024x1024": "10,10", "2048x2048": "11,11", "4096x4096": "12,12"}
FORMATS = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif", ".webp": "webp", ".bmp": "bmp", ".tif": "tiff", ".tiff": "tiff"}
SIGNATURES = {"png": ["89504E470D0A1A0A"], "jpeg": ["FFD8FF"], "gif": ["474946383761", "474946383961"], "bmp": ["424D"], "tiff": ["49492A00", "4D4D002A"]}
ARCHIVES = {"unity": [".unitypackage"], "zip": [".zip"], "tar": [".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".gz"]}


def kind_targets(kind: Column) -> Column:
    """The formats that a kind can become, sorted; none for an unknown kind."""
    out = F.array().cast("array<string>")
    for k, all_ in TARGETS.items():
        out = F.when(kind == k, F.array(*map(F.lit, sorted(set(all_))))).otherwise(out)
    return out


def converter(kind: Column, target: Column) -> Column:
    """What converts a kind into a format: 'picture', 'film', 'film to gif', 'sound of film', 'sound', 'document' or
    'pages'; null for pairs that nothing converts."""
    can = F.array_contains(kind_targets(kind), target)
    how = (
        F.when(kind.isin("image"), "picture").when((kind == "gif") & target.isin(PICTURES), "picture").when(target.isin(FILMS), "film").when((kind == "video") & (target == "gif"), "film to gif")
        .when(kind == "video", "sound of film").when(kind == "audio", "sound").when((kind == "pdf") & target.isin("png", "jpg"), "pages").otherwise("document")
    )
    return F.when(can, how)


def muxer(suffix: Column) -> Column:
    return lookup(F.lower(suffix), MUXERS)


def power_pair(label: Column) -> Column:
    """'WxH' as a pair of powers of two; 1024 x 1024 for any other label."""
    return lookup(label, POWERS, F.lit("10,10"))


def picture_format(head: Column) -> Column:
    """The picture format that the first bytes of a file show; null for none."""
    digits = F.hex(F.substring(head, 1, 12))
    out = F.when(digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250"), "webp")
    for name, marks in SIGNATURES.items():
        for mark in marks:
            out = F.when(digits.startswith(mark), name).otherwise(out)
    return out


def expected_format(suffix: Column) -> Column:
    return lookup(F.lower(suffix), FORMATS)


def archive_kind(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(ARCHIVES):
        ends = F.lit(False)
        for s in ARCHIVES[kind]:
            ends = ends | F.lower(name).endswith(s)
        out = F.when(ends, kind).otherwise(out)
    return out


def describe_sound(suffix: Column, target: Column, start: Column, end: Column, fade_in: Column, fade_out: Column, normalize: Column) -> Column:
    """What is done to a sound file, in words."""
    steps = F.array(
        F.when(F.lower(suffix) != F.concat(F.lit("."), target), F.concat(F.lit("convert→"), target)).otherwise(F.concat(F.lit("re-encode "), target)),
        F.when((F.trim(start) != "") | (F.trim(end) != ""), "trim"),
        F.when((F.coalesce(fade_in, F.lit(0.0)) > 0) | (F.coalesce(fade_out, F.lit(0.0)) > 0), "fade"),
        F.when(normalize, "normalize"),
    )
    return F.array_join(F.array_compact(steps), ", ")


def renderer_arguments(engine: Column, project: Column, folder: Column, *, size: Column | None = None, target: Column | None = None) -> Column:
    """Arguments that render a project into a folder: with a size for one renderer, with a target engine for the other."""
    if size is not None:
        fixed = ["--output-name", "{inputName}_{outputNodeName}", "--set-value"]
        return F.array(engine, F.lit("render"), F.lit("--inputs"), project, F.lit("--output-path"), folder, *map(F.lit, fixed), F.concat(F.lit("$outputsize@"), size))
    return F.array(engine, F.lit("--export-material"), F.lit("--target"), target, F.lit("-o"), folder, project)


def engine_problem(path: Column, exists: Column, stem: str) -> Column:
    """Why a file cannot be the wanted executable: 'engine.missing', 'engine.wrong' or null."""
    name = F.lower(F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", ""))
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", "engine.missing").when(~exists, "engine.missing").when(name != stem.lower(), "engine.wrong")


def shade(colour: list[Column], factor: float) -> Column:
    """A colour made lighter or darker, each part within 0 to 255."""
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c * factor).cast("int"))) for c in colour])


def known_kind(suffix: Column) -> Column:
    return F.lower(suffix).isin([s for all_ in KINDS.values() for s in all_])
