"""Whether the recorded results of jobs are what lies on disk, and what each tool's results must meet besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a tool's finished work is called, strips of a seam chart, bands of a contact sheet, most rendered files.
DONE = {
    "tiles": "checked", "clips": "chopped", "audit": "audited", "materials": "converted", "showcase": "rendered", "alpha": "cut", "vector": "converted", "render": "rendered", "convert": "converted",
    "extract": "extracted", "audio": "processed", "rescale": "resized", "scrub": "scrubbed", "pixel": "converted", "icon": "converted", "enhance": "enhanced", "compress": "compressed", "dataset": "processed",
}
STRIP_LENGTH, STRIP_BAND, LABEL_BAND, TITLE_BAND, MOST_RENDERED = 256, 18, 18, 44, 4096

RESULT = "job long, tool string, action string, dry_run boolean, retryable boolean, own_source boolean, out_path string, plan_path string, reason string, detail string, num map<string,double>, claims map<string,string>, found map<string,string>"
RECORDED = "job long, ord int, path string, bytes long, sha256 string, width int, height int, duration double, coverage double"
PLANNED = "job long, ord int, path string, width int, height int, start double, end double"
ACTUAL = "path string, bytes long, sha256 string, is_link boolean, format string, mode string, width int, height int, hard_alpha boolean, leaks int, duration double, coverage double, valid boolean"

#: Facts about all records of a job, of which `records` makes one row; nulls count as not holding.
FLAGS = {
    "same_paths": "r_path <=> p_path",
    "inside": "startswith(r_path, root) AND NOT contains(r_path, '/../')",
    "no_link": "NOT is_link",
    "there": "a_bytes IS NOT NULL",
    "same_size": "a_bytes = r_bytes",
    "same_digest": "a_sha256 = r_sha256",
    "filled": "a_bytes > 0",
    "tells_size": "r_bytes > 0",
    "tells_digest": "r_sha256 RLIKE '^[0-9a-f]{64}$'",
    "any_digest": "r_sha256 IS NOT NULL AND r_sha256 <> ''",
    "png": "format = 'PNG'",
    "png_name": "lower(r_path) LIKE '%.png'",
    "rgb": "mode = 'RGB'",
    "rgba": "mode = 'RGBA'",
    "has_area": "a_width > 0 AND a_height > 0",
    "planned_area": "a_width = p_width AND a_height = p_height",
    "as_recorded": "a_width = r_width AND a_height = r_height AND a_coverage <=> r_coverage",
    "valid": "valid",
    "ranges": "start >= 0 AND end > start AND end < double('infinity')",
    "lasts": "r_duration > 0 AND r_duration < double('infinity')",
    "plausible": "r_duration >= greatest(0.01D, least((end - start) * 0.25D, 0.25D)) AND r_duration <= (end - start) + greatest(1.0D, (end - start) * 0.5D)",
}

FILES = [("missing", "NOT there"), ("size", "NOT same_size"), ("digest", "NOT same_digest")]
ONE = [("records", "n <> 1")]
#: Of each tool what is wrong in which actions (done: the tool's own); None stands for every action. Conditions that are null
#: count as wrong.
RULES: dict[str, list[tuple[str, tuple[str, ...] | None, str]]] = {
    "tiles": [
        ("action", None, "action NOT IN ('checked', 'dry-run')"),
        ("scores", None, "NOT (num['x'] BETWEEN 0 AND 1 AND num['y'] BETWEEN 0 AND 1 AND num['overall'] BETWEEN 0 AND 1 AND abs(num['overall'] - least(num['x'], num['y'])) <= 1e-12D)"),
        ("plan", None, "NOT same_paths"), ("records", ("dry-run",), "n_digests > 0"), ("digest", ("done",), "n_digests <> planned OR NOT same_digest"), ("format", ("done",), "NOT (png AND rgb)"), ("geometry", ("done",), "NOT planned_area"),
    ],
    "clips": [
        ("action", None, "action NOT IN ('chopped', 'dry-run', 'skipped')"), ("count", ("dry-run", "done"), "NOT (num['count'] > 0 AND planned = num['count'])"), ("ranges", ("dry-run", "done"), "NOT ranges"), ("plan", ("dry-run", "done"), "NOT (same_paths AND out_path <=> plan_path)"),
        ("records", ("done",), "NOT (n = num['count'] AND n_digests = n AND tells_size)"), ("duration", ("done",), "NOT (lasts AND plausible)"), *[(p, ("done",), c) for p, c in FILES],
    ],
    "audit": [
        ("action", None, "action <> 'audited'"), ("retryable", None, "retryable"), ("records", None, "n <> 3"), ("plan", None, "NOT (same_paths AND out_path <=> plan_path)"), *[(p, None, c) for p, c in FILES], ("claims", None, "NOT agrees"),
        ("reason", None, "NOT reason <=> concat(claims['issues'], ' issue(s) across ', claims['scanned'], ' file(s)')"), ("detail", None, "NOT detail <=> if(num['warnings'] > 0, 'degraded', '')"),
    ],
    "materials": [
        ("action", None, "action NOT IN ('converted', 'dry-run', 'skipped')"), ("records", ("done",), "n = 0"), ("missing", ("done",), "NOT (there AND filled)"), ("geometry", ("done",), "NOT has_area OR num['resize'] > 0 AND NOT (min_side = num['resize'] AND max_side = num['resize'])"), ("claims", ("done",), "NOT agrees"),
    ],
    "showcase": [
        ("action", None, "action NOT IN ('rendered', 'dry-run')"), ("count", ("done",), "NOT num['count'] > 0"), ("records", ("done",), "n = 0 OR n_digests <> n"), ("missing", ("done",), "NOT there"), ("digest", ("done",), "NOT same_digest"), ("format", ("done",), "NOT png OR NOT has_area"),
        ("geometry", ("done",), f"""NOT CASE claims['mode'] WHEN 'hero' THEN first_width = greatest(32, num['cell']) AND first_height = greatest(32, num['cell'])
            WHEN 'contact' THEN first_width = greatest(0, num['pad']) + greatest(1, num['cols']) * (greatest(8, num['cell']) + greatest(0, num['pad']))
              AND first_height = if(claims['title'] <> '', {TITLE_BAND}, 0) + greatest(0, num['pad']) + greatest(1, ceil(num['count'] / greatest(1, num['cols']))) * (greatest(8, num['cell']) + if(num['labels'] > 0, {LABEL_BAND}, 0) + greatest(0, num['pad']))
            WHEN 'spritesheet' THEN if(num['sheet'] = 0 AND num['icons'] > 0, first_width = greatest(32, num['cell']) AND first_height = greatest(32, num['cell']),
              first_width = greatest(0, num['pad']) + greatest(1, num['cols']) * (greatest(16, num['cell']) + greatest(0, num['pad'])) AND first_height = greatest(0, num['pad']) + greatest(1, num['rows']) * (greatest(16, num['cell']) + greatest(0, num['pad'])))
            ELSE claims['mode'] = 'before_after' END"""),
    ],
    "alpha": [
        ("action", None, "action NOT IN ('cut', 'dry-run', 'skipped')"), ("retryable", None, "retryable"), ("source", None, "NOT own_source"), ("plan", None, "NOT out_path <=> plan_path"), ("settings", None, "dry_run <> (action = 'dry-run')"), ("records", ("dry-run", "skipped"), "n > 0"), ("detail", ("skipped",), "NOT detail <=> 'empty-matte'"),
        *[(p, ("done",), c) for p, c in ONE], ("plan", ("done",), "NOT same_paths"), *[(p, ("done",), c) for p, c in FILES], ("format", ("done",), "NOT (png AND rgba)"), ("geometry", ("done",), "NOT as_recorded OR NOT first_coverage <=> num['coverage']"),
    ],
    "vector": [
        ("action", None, "action NOT IN ('converted', 'dry-run')"), ("source", None, "NOT own_source"), ("plan", None, "NOT out_path <=> plan_path"), ("settings", None, "dry_run <> (action = 'dry-run')"), ("records", ("dry-run",), "n > 0"), *[(p, ("done",), c) for p, c in ONE],
        ("plan", ("done",), "NOT same_paths"), *[(p, ("done",), c) for p, c in FILES], ("format", ("done",), "NOT valid"), ("geometry", ("done",), "NOT as_recorded"),
    ],
    "render": [
        ("action", None, "action NOT IN ('rendered', 'dry-run')"), ("retryable", None, "retryable"), ("source", None, "NOT own_source"), ("settings", None, "dry_run <> (action = 'dry-run')"), ("records", ("dry-run",), "n > 0"), ("records", ("done",), f"n = 0 OR n > {MOST_RENDERED} OR NOT tells_size OR NOT tells_digest"),
        ("plan", ("done",), "NOT out_path <=> plan_path"), ("repeated", ("done",), "paths < n"), ("outside", ("done",), "NOT inside"), ("link", ("done",), "NOT no_link"), *[(p, ("done",), c) for p, c in FILES],
        ("format", ("done",), "claims['kind'] = 'mm' AND NOT (png_name AND has_area)"), ("geometry", ("done",), "claims['kind'] = 'mm' AND num['resize'] > 0 AND NOT (min_width = num['resize'] AND max_width = num['resize'] AND min_height = num['resize'] AND max_height = num['resize'])"),
    ],
    "convert": [
        ("action", None, "action NOT IN ('converted', 'dry-run', 'skipped')"), ("source", None, "NOT own_source"), ("claims", None, "NOT agrees"), ("settings", ("dry-run", "done"), "dry_run <> (action = 'dry-run')"), ("records", ("dry-run", "skipped"), "n > 0"),
        ("reason", None, "NOT reason <=> CASE action WHEN 'skipped' THEN 'source is already the target format' WHEN 'dry-run' THEN concat('would convert ', claims['before'], ' → ', claims['after']) ELSE concat(claims['before'], ' → ', claims['after']) END"),
        ("plan", None, "NOT if(action = 'skipped', out_path IS NULL, out_path <=> plan_path)"), ("records", ("done",), "n = 0"), ("plan", ("done",), "NOT same_paths"), *[(p, ("done",), c) for p, c in FILES],
    ],
    "extract": [
        ("action", None, "action NOT IN ('extracted', 'dry-run')"), ("settings", None, "dry_run <> (action = 'dry-run')"), ("plan", None, "NOT out_path <=> plan_path"), ("count", None, "NOT (num['written'] >= 0 AND num['skipped'] >= 0 AND num['rejected'] >= 0 AND num['errors'] >= 0 AND num['listed'] >= 0)"),
        ("records", ("dry-run",), "num['written'] <> 0 OR n > 0"), ("reason", ("dry-run",), "NOT reason <=> concat(cast(num['listed'] AS bigint), ' entries would extract')"), ("claims", None, "NOT agrees"),
        ("reason", ("done",), """NOT reason <=> concat('wrote ', cast(num['written'] AS bigint), if(num['skipped'] > 0, concat(', skipped ', cast(num['skipped'] AS bigint)), ''),
            if(num['rejected'] > 0, concat(', rejected ', cast(num['rejected'] AS bigint)), ''), if(num['errors'] > 0, concat(', errors ', cast(num['errors'] AS bigint)), ''))"""),
        ("count", ("done",), "NOT n = num['written']"), ("repeated", ("done",), "paths < n"), ("outside", ("done",), "NOT inside"), ("records", ("done",), "NOT tells_digest"), *[(p, ("done",), c) for p, c in FILES],
    ],
    "audio": [
        ("action", None, "action NOT IN ('processed', 'dry-run', 'skipped')"), ("plan", ("dry-run", "done"), "NOT out_path <=> plan_path"), ("records", ("done",), "NOT (n = 1 AND tells_size AND n_digests = 1)"), ("duration", ("done",), "NOT lasts"), *[(p, ("done",), c) for p, c in FILES],
    ],
    "rescale": [("action", None, "action NOT IN ('resized', 'dry-run', 'skipped')"), ("missing", ("done",), "NOT first_bytes > 0"), ("geometry", ("done",), "NOT claims['after'] <=> concat(first_width, 'x', first_height)")],
    "scrub": [("action", None, "action = 'failed'"), ("missing", ("done",), "first_bytes IS NULL"), ("claims", ("done",), "first_bytes IS NOT NULL AND NOT first_leaks = 0")],
    "pixel": [
        ("action", None, "action NOT IN ('converted', 'dry-run')"), ("missing", ("done",), "first_bytes IS NULL"), ("format", ("done",), "NOT (first_format = 'PNG' AND first_mode = 'RGBA' AND first_hard)"),
        ("geometry", ("done",), "NOT if(num['upscale'] > 0, first_width = num['width'] AND first_height = num['height'], first_width = greatest(1, floor(num['width'] / greatest(1, num['pixel']))) AND first_height = greatest(1, floor(num['height'] / greatest(1, num['pixel']))))"),
    ],
    "icon": [
        ("action", None, "action NOT IN ('converted', 'dry-run', 'skipped')"), ("missing", ("done",), "first_bytes IS NULL"), ("format", ("done",), "NOT (first_format = 'PNG' AND first_mode = 'RGBA')"),
        ("geometry", ("done",), "NOT (first_width > 0 AND first_width = first_height AND claims['after'] <=> concat(first_width, 'x', first_height))"),
    ],
    "enhance": [("action", None, "action NOT IN ('enhanced', 'needs-review', 'dry-run')"), ("missing", ("done", "needs-review"), "NOT first_bytes > 0"), ("format", ("done", "needs-review"), "NOT first_valid")],
    "compress": [("action", None, "action NOT IN ('compressed', 'dry-run', 'skipped')"), ("missing", ("done",), "NOT first_bytes > 0"), ("geometry", ("done",), "NOT (first_width > 0 AND first_height > 0)"), ("duration", ("done",), "NOT first_duration > 0")],
    "dataset": [
        ("action", None, "action NOT IN ('processed', 'preview')"), ("retryable", None, "retryable"), ("settings", None, "dry_run <> (action = 'preview')"), ("records", ("preview",), "n > 0 OR out_path IS NOT NULL"), ("count", None, "NOT num['failed'] = 0"), ("detail", ("preview",), "NOT detail <=> 'preview'"),
        ("plan", ("done",), "NOT out_path <=> plan_path"), ("claims", ("done",), "NOT agrees"), ("records", ("done",), "n = 0"), ("repeated", ("done",), "paths < n"), ("outside", ("done",), "NOT inside"), *[(p, ("done",), c) for p, c in FILES], ("detail", ("done",), "NOT detail <=> if(num['degraded'] > 0, 'degraded', '')"),
    ],
}


def facts(results: DataFrame, recorded: DataFrame, planned: DataFrame, actual: DataFrame) -> DataFrame:
    """results with what their records show: counts, FLAGS over all records and plans of the job, and what lies at the first."""
    name = lambda df, p, keep: df.select(*[F.col(c).alias(c if c in keep else f"{p}_{c}") for c in df.columns])
    pairs = name(recorded, "r", ("job", "ord")).join(name(planned, "p", ("job", "ord")).withColumnsRenamed({"p_start": "start", "p_end": "end"}), ["job", "ord"], "full_outer")
    lies = name(actual, "a", ("is_link", "format", "mode", "hard_alpha", "leaks", "valid"))
    each = pairs.join(lies, F.col("r_path") == F.col("a_path"), "left").join(results.select("job", F.concat("root", F.lit("/")).alias("root")), "job")
    flags = [F.bool_and(F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in FLAGS.items() if k != "any_digest"]
    first = F.min_by(F.struct("a_bytes", "a_width", "a_height", "format", "mode", "hard_alpha", "leaks", "a_duration", "valid", "r_coverage"), "ord").alias("first")
    sides = [f("a_" + c).alias(f"{k}_{c}") for c in ("width", "height") for k, f in (("min", F.min), ("max", F.max))]
    both = F.greatest("a_width", "a_height")
    counts = each.groupBy("job").agg(
        F.count("r_path").alias("n"), F.count("p_path").alias("planned"), F.countDistinct("r_path").alias("paths"), F.count_if(F.expr(FLAGS["any_digest"])).alias("n_digests"), F.min(both).alias("min_side"), F.max(both).alias("max_side"), *sides, first, *flags,
    )
    found = {"bytes": "a_bytes", "width": "a_width", "height": "a_height", "format": "format", "mode": "mode", "hard": "hard_alpha", "leaks": "leaks", "duration": "a_duration", "valid": "valid", "coverage": "r_coverage"}
    joined = results.join(counts, "job", "left").withColumns({f"first_{k}": F.col(f"first.{c}") for k, c in found.items()})
    none = {k: F.coalesce(k, F.lit(0).cast("long")) for k in ("n", "planned", "paths", "n_digests")} | {k: F.coalesce(k, F.lit(True)) for k in FLAGS if k != "any_digest"}  # of no records all is true
    return joined.withColumns(none).withColumn("agrees", F.coalesce(F.forall(F.map_keys("found"), lambda k: F.col("claims")[k].eqNullSafe(F.col("found")[k])), F.lit(True)))


def verify(results: DataFrame, recorded: DataFrame, planned: DataFrame, actual: DataFrame) -> DataFrame:
    """(job, problems): for each result, one row a job, all that is wrong with it by the rules of its tool, sorted; empty
    where the result can be used again.

    results are as RESULT has them, with `root`, the folder that the job may write to; recorded are the artifacts that it
    tells of, planned those that its settings lead to, in order, and actual what lies on disk (all paths once). `claims`
    and `num` are what the result says, `found` what its report or source says: keys that found has must be equal. A tool
    without rules, and an action that failed, is a problem with the action. Jobs meet their records by one aggregation, so
    that a job of any number of records is no row of its own before it is counted.
    """
    known = facts(results, recorded, planned, actual)
    done = F.lit(None).cast("string")
    for tool, name in DONE.items():
        done = F.when(F.col("tool") == tool, name).otherwise(done)
    stage = F.when((F.col("action") == done) | (F.col("tool") == "scrub") & ~F.col("action").isin("failed", "skipped", "dry-run"), "done").otherwise(F.col("action"))
    problems = [F.when(~F.coalesce(F.col("tool").isin(list(RULES)), F.lit(False)) | F.col("action").isNull(), "action")]
    for tool, rules in RULES.items():
        here = [F.when(F.coalesce(F.expr(wrong), F.lit(True)) & (F.col("stage").isin(list(stages)) if stages else F.lit(True)), problem) for problem, stages, wrong in rules]
        problems.extend(F.when(F.col("tool") == tool, h) for h in here)
    return known.withColumn("stage", stage).select("job", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*problems)))), ",").alias("problems"))


#: What must hold for a record of each tool beyond its path, size and digest, as expressions on the record.
RECORD_RULES = {
    "tiles": "x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND abs(score - least(x, y)) <= 1e-12",
    "clips": "duration >= greatest(0.01, least(wanted * 0.25, 0.25)) AND duration <= wanted + greatest(1.0, wanted * 0.5)",
    "audit": "suffix IN ('.json', '.csv', '.html')",
    "materials": "width > 0 AND height > 0",
    "hero": "width = greatest(32, cell) AND height = width",
    "contact": "width = pad + cols * (cell + pad)",
    "sheet": "width = pad + cols * (cell + pad) AND height = pad + lines * (cell + pad)",
    "alpha": "(action = 'skipped') = (coverage < 0.005)",
    "vector": "suffix = '.svg'",
    "render": "suffix = '.png'",
    "convert": "bytes > 0",
    "extract": "bytes >= 0",
    "audio": "duration > 0",
    "rescale": "width = want_width AND height = want_height",
    "scrub": "leaks = 0",
    "pixel": "mode = 'RGBA' AND half_alpha = 0",
    "icon": "mode = 'RGBA' AND width = height AND width = want_width",
    "enhance": "bytes > 0 AND width > 0",
    "compress": "width > 0 AND height > 0 AND duration > 0",
}


def keeps_rule(tool: Column) -> Column:
    """Whether a record meets its tool's rule; tools without one have none to meet."""
    out = F.lit(True)
    for name, rule in RECORD_RULES.items():
        out = F.when(tool == name, F.coalesce(F.expr(rule), F.lit(False))).otherwise(out)
    return out


def validate(records: DataFrame, actual: DataFrame, root: str) -> DataFrame:
    """(job, problem) for each job of the records: null, or the first of 'repeated', 'outside', 'missing', 'size',
    'digest', 'rule' that any record shows, or 'extra' where a file of the job is not recorded.

    records: job, path, bytes, sha256, ok (whether the tool's rule holds); actual: job, path, bytes, sha256.
    """
    counted = records.groupBy("job", "path").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"), F.min("ok").alias("ok"))
    found = actual.select("path", F.col("bytes").alias("is_bytes"), F.col("sha256").alias("is_sha"), F.lit(True).alias("there"))
    at = F.when(F.col("n") > 1, 1).when(~F.col("path").startswith(root.rstrip("/") + "/") | F.col("path").contains("/../"), 2).when(F.col("there").isNull(), 3)
    at = at.when(~F.col("is_bytes").eqNullSafe(F.col("bytes")), 4).when(~F.col("is_sha").eqNullSafe(F.col("sha256")), 5).when(~F.col("ok"), 6)
    recorded = counted.join(found, "path", "left").select("job", at.alias("at"))
    extra = actual.join(records.select("path").distinct(), "path", "left_anti").select("job", F.lit(7).alias("at")).join(records.select("job").distinct(), "job", "left_semi")
    names = F.array(*map(F.lit, ["repeated", "outside", "missing", "size", "digest", "rule", "extra"]))
    worst = recorded.unionByName(extra).groupBy("job").agg(F.min("at").alias("at"))
    return worst.select("job", F.try_element_at(names, F.col("at")).alias("problem"))


def missing_pages(pages: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing, extra): page numbers of 1..n that a group of n pages lacks, and those it should not have."""
    counted = pages.groupBy(group).agg(F.count("*").alias("n"), F.collect_set(number).alias("has"))  # the pages of one document
    wanted = F.sequence(F.lit(1).cast("long"), F.col("n"))
    return counted.select(group, F.array_join(F.array_sort(F.array_except(wanted, "has")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("has", wanted)), ",").alias("extra"))
