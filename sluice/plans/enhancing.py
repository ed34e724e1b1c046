"""Plans of the picture enhancer, vector files and pages, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enhance
from ..operators import pictures
from .registry import query, table

# Profiles made from order lines, and the settings they lead to.
PROFILE = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS mean_luma, CAST(l_discount AS DOUBLE) * 4 AS shadows, CAST(l_tax AS DOUBLE) * 3 AS highlights, CAST(l_quantity AS DOUBLE) / 55 AS saturation, CASE l_linenumber % 4 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' ELSE 'neutral' END AS cast, CAST(l_discount AS DOUBLE) * 5 AS cast_strength, CAST(l_tax AS DOUBLE) * 3 AS sharpness, CAST(l_discount AS DOUBLE) AS noise, CAST(l_quantity AS DOUBLE) / 60 AS specular_gap, CAST(l_quantity AS DOUBLE) / 7 AS noise_sigma, 1 - CAST(l_discount AS DOUBLE) * 5 AS confidence, CASE l_linenumber % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'hybrid' ELSE 'deterministic' END AS advice, CAST(l_quantity AS INTEGER) * 20 AS width, 100 AS height, CAST(l_tax AS DOUBLE) / 10 AS face FROM lineitem"


@query(
    f"""WITH p AS (SELECT * RENAME ("cast" AS tone) FROM ({PROFILE.replace(' AS cast,', ' AS "cast",')})), q AS (SELECT *, face > 0.004::DOUBLE AS has_face, CASE WHEN confidence >= 0.55::DOUBLE THEN advice ELSE 'hybrid' END AS mode FROM p),
r AS (SELECT *, CASE WHEN has_face AND specular_gap > 0.25::DOUBLE THEN round(least(0.85::DOUBLE, specular_gap * 1.4::DOUBLE), 3) ELSE 0.0::DOUBLE END AS de_gloss, CASE WHEN saturation < 0.64::DOUBLE THEN least(0.10::DOUBLE, (0.64::DOUBLE - saturation) * 0.5::DOUBLE + 0.02::DOUBLE) * CASE WHEN has_face THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS v FROM q),
s AS (SELECT *, CASE WHEN de_gloss > 0 THEN 0.0::DOUBLE ELSE v END AS k, CASE mode WHEN 'deterministic' THEN 1 WHEN 'hybrid' THEN CASE WHEN greatest(width, height) < 768 THEN 2 ELSE 1 END ELSE 4 END AS scale FROM r)
SELECT l_orderkey, l_linenumber, round((1 + greatest(0.0::DOUBLE, least(0.65::DOUBLE, (0.36::DOUBLE - mean_luma) * 1.8::DOUBLE))) * (1 + k * 0.6::DOUBLE), 4) AS brightness, round(1 + greatest(0.0::DOUBLE, least(0.15::DOUBLE, (0.45::DOUBLE - (1 - shadows - highlights)) * 0.25::DOUBLE)), 4) AS contrast,
round(1 - greatest(0.0::DOUBLE, least(0.30::DOUBLE, (saturation - 0.56::DOUBLE) * 0.7::DOUBLE)), 4) AS saturation_factor, round(CASE WHEN tone = 'warm' AND cast_strength > 0.32::DOUBLE THEN -least(0.05::DOUBLE, (cast_strength - 0.32::DOUBLE) * 0.5::DOUBLE) WHEN tone = 'cool' AND cast_strength > 0.08::DOUBLE THEN least(0.08::DOUBLE, cast_strength * 0.5::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS temperature,
mode, CAST(scale AS INTEGER) AS scale, mode = 'ai' OR (mode = 'hybrid' AND scale > 1) AS use_model FROM s"""
)
def enhancement_plan(spark, sf_dir):
    """Bounded settings, the mode and whether a model is needed, from each profile."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(PROFILE)
    settings = enhance.plan("hybrid", True, 1, F.col("face"))
    wanted = [settings[k] for k in ("brightness", "contrast", "saturation_factor", "temperature")]
    return rows.select("l_orderkey", "l_linenumber", *wanted, settings["mode"], settings["scale"], settings["use_model"])


SETTINGS = {"clarity": "CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", "contrast": "CASE WHEN p_size % 3 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END", "vignette": "CASE WHEN p_size % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END"}


@query(
    f"""WITH s AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in SETTINGS.items())} FROM part)
SELECT p_partkey, concat_ws(',', 'saturation=0.0', 'contrast=1.25', 'clarity=0.35', 'film_grain=0.035', 'vignette=0.35', CASE WHEN clarity > 0 THEN 'clarity=0.5' END, CASE WHEN contrast <> 1 THEN 'contrast=1.5' END, CASE WHEN vignette > 0 THEN 'vignette=0.25' END) AS stack FROM s"""
)
def pass_stacks(spark, sf_dir):
    """The passes of a preset and the sliders behind them; idle ones are left out."""
    on = lambda n, x, idle: F.when(F.col("p_size") % n == 0, x).otherwise(idle)
    given = {"clarity": on(2, 0.5, 0.0), "contrast": on(3, 1.5, 1.0), "vignette": on(5, 0.25, 0.0)}
    sliders = {s: given.get(s, F.lit(1.0 if s in enhance.FACTORS else 0.0)) for _, _, s, _ in enhance.SLIDERS}
    rows = table(spark, sf_dir, "part").withColumns(sliders)
    steps = F.transform(enhance.stack("bw_contrast"), lambda s: F.concat(s["op"], F.lit("="), s["value"].cast("string")))
    return rows.select("p_partkey", F.array_join(steps, ",").alias("stack"))


VECTOR = "CASE page_id % 5 WHEN 0 THEN '<?xml version=\"1.0\"?>' || chr(10) || '<svg>' || html || '<path d=\"M0\"/></svg>' WHEN 1 THEN '<!DOCTYPE svg><svg/>' WHEN 2 THEN '' WHEN 3 THEN html ELSE '<!-- x --><s:svg><s:path/><path/></s:svg>' END"


@query(
    f"""WITH v AS (SELECT page_id, {VECTOR} AS svg FROM pages) SELECT page_id, CASE WHEN svg = '' THEN 'size' WHEN contains(lower(svg), '<!doctype') OR contains(lower(svg), '<!entity') THEN 'declaration' WHEN page_id % 5 = 3 THEN 'root' END AS problem,
CAST(len(regexp_extract_all(svg, '<[A-Za-z_]')) AS INTEGER) AS elements, CAST(len(regexp_extract_all(svg, '<(?:s:)?path\\b')) AS INTEGER) AS paths FROM v"""
)
def vector_checks(spark, sf_dir):
    """Whether vector files are safe, and how many elements and paths they have."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    rows = spark.sql(f"SELECT page_id, {VECTOR.replace('chr(10)', 'char(10)')} AS svg FROM pages")
    return rows.select("page_id", enhance.vector_problem(F.col("svg")).alias("problem"), enhance.elements(F.col("svg")).alias("elements"), enhance.elements(F.col("svg"), "path").alias("paths"))


@query(
    """WITH t AS (SELECT doc_id, 'Results' || chr(10) || replace(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), 'er ', 'er-' || chr(10)) || chr(10) || '2.1 Related Work here' AS text FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, regexp_replace(text, '(\\b[a-zA-Z]{2,})-\\n([a-zA-Z]{2,}\\b)', '\\1\\2', 'g') AS text FROM t),
l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS lines FROM c)
SELECT doc_id, md5(chr(10) || '<!-- Page 7 -->' || chr(10) || '*Page 7*' || chr(10) || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN length(x) < 80 AND regexp_matches(x, '(?i)^(?:[0-9]+(?:\\.[0-9]+)*\\s+)?(?:"""
    + enhance.SECTIONS
    + """)\\b') THEN chr(10) || '## ' || x || chr(10) ELSE x END), chr(10)) || chr(10)) AS digest FROM l"""
)
def pages_as_markdown(spark, sf_dir):
    """Texts of pages as Markdown, by digest."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")  # the two engines' word boundaries agree on ASCII
    text = F.concat(F.lit("Results\n"), F.replace(plain, F.lit("er "), F.lit("er-\n")), F.lit("\n2.1 Related Work here"))
    return docs.select("doc_id", F.md5(enhance.page_markdown(text, F.lit(7))).alias("digest"))


@query()
def picture_profiles(spark, sf_dir):
    """Profiles of pictures made from vectors and the settings they lead to, end to end."""
    base = pictures.from_numbers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    kinds = "width int, height int, mean_luma double, shadows double, highlights double, saturation double, cast string, cast_strength double, sharpness double, noise double, specular_gap double, noise_sigma double, confidence double, advice string"
    rows = pictures.measure(base, ["profile"]).select("vec_id", F.from_json("profile", kinds).alias("p")).select("vec_id", "p.*")
    settings = enhance.plan("hybrid", True, 1)
    return rows.select("vec_id", "cast", "advice", *settings.values())
