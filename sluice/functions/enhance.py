"""Plans of the picture enhancer as expressions: settings from a profile, stacks of passes, checks of vector files, pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def plan(mode: str, auto: bool, scale: int, face: Column | None = None) -> dict[str, Column]:
    """Settings by name, from the columns of a profile (see passes.profile): bounded and all neutral for a good picture.

    `mode` is what was asked for; with `auto` a confident profile's advice takes its place. Skin work needs a face: `face`
    is the share of the picture that faces cover. Constants are fixed values.
    """
    if mode not in ("deterministic", "hybrid", "ai") or scale not in (1, 2, 3, 4):
        raise ValueError("mode is deterministic, hybrid or ai, scale 1 to 4")
    c = F.col
    zero = F.lit(0.0)
    has_face = F.coalesce(face if face is not None else zero, zero) > 0.004
    effective = F.when(F.lit(auto) & (c("confidence") >= 0.55), c("advice")).otherwise(mode) if mode != "deterministic" else F.lit(mode)
    vibrance = F.when(c("saturation") < 0.64, F.least(F.lit(0.10), (0.64 - c("saturation")) * 0.5 + 0.02) * F.when(has_face, 0.5).otherwise(1.0)).otherwise(zero)
    gloss = F.when(has_face & (c("specular_gap") > 0.25), F.round(F.least(F.lit(0.85), c("specular_gap") * 1.4), 3)).otherwise(zero)
    kept = F.when(gloss > 0, zero).otherwise(vibrance)  # less shine deepens colour by itself
    clear = 1 - c("shadows") - c("highlights")
    soft = F.when((c("sharpness") < 0.18) & (c("noise") < 0.06), F.least(F.lit(0.35), (0.18 - c("sharpness")) * 1.9)).when(c("noise") < 0.09, F.when(has_face, 0.03).otherwise(0.06)).otherwise(zero)
    warm = F.when((c("cast") == "warm") & (c("cast_strength") > 0.32), -F.least(F.lit(0.05), (c("cast_strength") - 0.32) * 0.5))
    warm = warm.when((c("cast") == "cool") & (c("cast_strength") > 0.08), F.least(F.lit(0.08), c("cast_strength") * 0.5)).otherwise(zero)
    small = F.greatest("width", "height") < 768
    wide = F.when(effective == "deterministic", 1).when((effective == "hybrid") & F.lit(auto and scale == 1) & small, 2).when((effective == "ai") & F.lit(scale == 1), 4).otherwise(scale)
    settings = {
        "brightness": (1 + between((0.36 - c("mean_luma")) * 1.8, 0.0, 0.65)) * (1 + kept * 0.6),
        "contrast": 1 + between((0.45 - clear) * 0.25, 0.0, 0.15),
        "gamma": 1 + between((0.30 - c("mean_luma")) * 1.2, 0.0, 0.40),
        "saturation_factor": 1 - between((c("saturation") - 0.56) * 0.7, 0.0, 0.30),
        "temperature": warm,
        "sharpen": 1 + soft,
        "vibrance": kept,
        "clarity": F.when(c("noise") < 0.09, F.when(has_face, 0.03).otherwise(0.05)).otherwise(zero),
        "denoise": F.greatest(between((c("noise") - 0.04) * 3.0, 0.0, 0.45), F.round(between((c("noise_sigma") - 2.5) / 5.5, 0.0, 1.0), 3)),
        "de_gloss": gloss,
        "micro_texture": F.when(has_face & (c("sharpness") < 0.12) & (c("noise") < 0.03), 0.035).otherwise(zero),
    }
    out = {k: F.round(v, 4).alias(k) for k, v in settings.items()}
    out["mode"] = effective.alias("mode")
    out["scale"] = wide.alias("scale")
    out["use_model"] = ((effective == "ai") | ((effective == "hybrid") & (wide > 1))).alias("use_model")
    return out


#: The passes that sliders add behind a preset, in order: (pass, what it takes, the slider and its factor). Fixed values.
SLIDERS = [
    ("white_balance", "p", "auto_wb", None), ("despeckle", "radius", "despeckle", None), ("local_contrast", "clip", "clahe", 3.0), ("denoise", "strength", "denoise", 1.0), ("de_gloss", "strength", "de_gloss", 1.0),
    ("micro_texture", "amount", "micro_texture", 1.0), ("clarity", "amount", "clarity", 1.0), ("brightness", "factor", "brightness", 1.0), ("contrast", "factor", "contrast", 1.0), ("gamma", "value", "gamma", 1.0),
    ("temperature", "amount", "temperature", 1.0), ("tint", "amount", "tint", 1.0), ("hue", "degrees", "hue", 1.0), ("saturation", "factor", "saturation", 1.0), ("vibrance", "amount", "vibrance", 1.0),
    ("split_tone", "amount", "split_tone", 1.0), ("soft_glow", "opacity", "soft_glow", 1.0), ("vignette", "amount", "vignette", 1.0), ("film_grain", "amount", "film_grain", 1.0), ("radial_focus", "radius", "radial_focus", 30.0),
    ("privacy_blur", "radius", "privacy_blur", 40.0), ("high_pass", "opacity", "high_pass", 1.0), ("edge_boost", "amount", "edge_boost", 1.0), ("sharpen", "factor", "sharpen", 1.0),
]
FACTORS = ["brightness", "contrast", "saturation", "sharpen", "gamma"]
#: Switches add a pass of fixed strength.
SWITCHES = {"auto_wb": 6.0, "despeckle": 1.0}
STACKS = {
    "natural": [], "gentle_restore": [("denoise", 0.5), ("contrast", 1.03)], "detail": [("denoise", 0.3), ("clarity", 0.10)], "colour_restore": [("denoise", 0.3), ("contrast", 1.08), ("saturation", 1.12), ("vibrance", 0.10)],
    "bw_contrast": [("saturation", 0.0), ("contrast", 1.25), ("clarity", 0.35), ("film_grain", 0.035), ("vignette", 0.35)], "red_eye_fix": [("red_eye", 1.0)],
}


def stack(preset: str) -> Column:
    """The passes (op, value) of a preset and of the sliders, columns of these names, in their order; a pass whose value does
    nothing is left out, neighbours that multiply become one."""
    if preset not in STACKS:
        raise ValueError(f"unknown preset {preset!r}")
    steps = [F.struct(F.lit(op).alias("op"), F.lit(float(v)).alias("value")) for op, v in STACKS[preset]]
    for op, _, slider, factor in SLIDERS:
        value = F.when(F.col(slider) > 0, SWITCHES[slider]).otherwise(0.0) if slider in SWITCHES else F.col(slider).cast("double") * factor
        steps.append(F.struct(F.lit(op).alias("op"), value.alias("value")))
    idle = lambda s: s["value"] == F.when(s["op"].isin(FACTORS), 1.0).otherwise(0.0)
    return merged(F.filter(F.array(*steps), lambda s: ~idle(s)))


def merged(steps: Column) -> Column:
    """Neighbours of one multiplying pass as one, their factors multiplied."""
    empty = F.array().cast("array<struct<op:string,value:double>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        same = (last["op"] == s["op"]) & s["op"].isin([f for f in FACTORS if f != "gamma"])
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(s["op"].alias("op"), (last["value"] * s["value"]).alias("value"))))
        return F.when(F.coalesce(same, F.lit(False)), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(steps, empty, add)


def vector_problem(text: Column, most_bytes: int = 512 << 20, most_elements: int = 1_000_000) -> Column:
    """Why a text is no safe vector picture: 'size', 'declaration', 'root', 'elements' or null."""
    root = F.lower(F.regexp_extract(F.regexp_replace(text, r"(?s)^\s*(<\?.*?\?>|<!--.*?-->|\s+)*", ""), r"^<(?:[\w.-]+:)?([\w.-]+)", 1))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return (
        F.when(~size.between(1, most_bytes), "size")
        .when(F.lower(text).contains("<!doctype") | F.lower(text).contains("<!entity"), "declaration")
        .when(root != "svg", "root")
        .when(elements(text) > most_elements, "elements")
    )


def elements(text: Column, name: str | None = None) -> Column:
    """How many elements a text opens, or how many of one name."""
    return F.regexp_count(text, F.lit(rf"<(?:[\w.-]+:)?{name}\b" if name else r"<[A-Za-z_]"))


#: Words that begin the sections of a paper.
SECTIONS = "Abstract|Introduction|Related Work|Background|Method|Methodology|Overview|Architecture|Framework|Experiments|Results|Ablation Studies|Discussion|Conclusion|Limitations|Future Work|Broader Impact|Ethics Statement|References|Appendix"


def page_markdown(text: Column, number: Column) -> Column:
    """The text of one page as Markdown: words cut at line ends joined, section titles as headings, the page's number above."""
    clean = F.regexp_replace(F.translate(text, "\x00￾", ""), r"(\b[a-zA-Z]{2,})-\n([a-zA-Z]{2,}\b)", "$1$2")
    title = rf"(?i)^(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:{SECTIONS})\b"
    lines = F.transform(F.split(clean, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.transform(lines, lambda x: F.when((F.length(x) < 80) & x.rlike(title), F.concat(F.lit("\n## "), x, F.lit("\n"))).otherwise(x))
    n = number.cast("string")
    return F.concat(F.lit("\n<!-- Page "), n, F.lit(" -->\n*Page "), n, F.lit("*\n\n"), F.array_join(lines, "\n"), F.lit("\n"))
