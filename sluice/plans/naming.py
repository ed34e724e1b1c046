"""Names, paths, texts and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, numbers
from ..operators import jsonwalk, tables
from .registry import dealt, inline, numbered, query, sql_values, table

TITLE = r"<title>(.*?)</title>"
NAMES = [("CON",), ("CON.png",), ("a<b.png",), ("trailing.png ",), ("dotend.",), ("normal_asset.png",), ("CONSTANTS.png",), ("",), ("com1.txt",), ("a\\b",), ("x..",), (" lead",)]
RESERVED_SQL = "'CON','PRN','AUX','NUL'," + ",".join(f"'{d}{i}'" for d in ("COM", "LPT") for i in range(1, 10))
TITLES_SQL = "(SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS name FROM pages UNION ALL SELECT name FROM " + sql_values(NAMES, "name") + ")"


def titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", TITLE, 1).alias("name"))
    return pages.unionAll(inline(spark, NAMES, "name string"))


@query(f"""SELECT name, (name = '' OR upper(split_part(name, '.', 1)) IN ({RESERVED_SQL}) OR regexp_matches(name, '[<>:"/\\\\|?*\\x00-\\x1f]') OR regexp_matches(name, '[. ]$')) AS unsafe FROM {TITLES_SQL}""")
def unsafe_names(spark, sf_dir):
    return titles(spark, sf_dir).select("name", names.is_unsafe_name(F.col("name")).alias("unsafe"))


def safe_sql(x):
    clean = f"""regexp_replace(trim(regexp_replace({x}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')), '[. ]+$', '')"""
    clean = f"CASE WHEN {clean} = '' THEN '_' ELSE {clean} END"
    return f"CASE WHEN upper(split_part({clean}, '.', 1)) IN ({RESERVED_SQL}) THEN '_' || ({clean}) ELSE {clean} END"


@query(f"SELECT name, {safe_sql('name')} AS safe FROM {TITLES_SQL}")
def safe_component(spark, sf_dir):
    return titles(spark, sf_dir).select("name", names.safe_name(F.col("name")).alias("safe"))


PATHS = [("../up/x.txt",), ("/abs/x",), ("C:\\w\\x",), ("~/h",), ("a\\b\\..\\c",), ("a/./b//c?.txt",), ("ok/CON/x",), ("./",), ("dir\\file.txt",)]


@query(
    f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages UNION ALL SELECT path FROM {sql_values(PATHS, 'path')}),
q AS (SELECT path, replace(path, '\\', '/') AS s FROM p), r AS (SELECT path, s, list_filter(string_split(s, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM q)
SELECT path, CASE WHEN NOT regexp_matches(s, '^(/|~|[A-Za-z]:)') AND NOT list_contains(parts, '..') AND len(parts) > 0
THEN array_to_string(list_transform(parts, lambda y: {safe_sql('y')}), '/') END AS safe FROM r"""
)
def safe_relpath(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("path"))
    paths = pages.unionAll(inline(spark, PATHS, "path string"))
    return paths.select("path", names.safe_relative_path(F.col("path")).alias("safe"))


SANITIZE_SQL = """regexp_replace(regexp_replace(regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"""


@query(f"SELECT name, substring(CASE WHEN {SANITIZE_SQL} = '' THEN 'untitled' ELSE {SANITIZE_SQL} END, 1, 200) AS clean FROM {TITLES_SQL}")
def sanitize_title(spark, sf_dir):
    return titles(spark, sf_dir).select("name", names.sanitize_title(F.col("name")).alias("clean"))


@query("SELECT doc_id, replace(text, 'the', 'THE') AS text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n FROM documents")
def caption_replace_literal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", names.replace_text(F.col("text"), "the", "THE").alias("text"), names.count_matches(F.col("text"), "the").alias("n"))


@query("SELECT conv_id, turn, regexp_replace(text, '([a-z]+)ing ', '\\1ed ', 'g') AS text, CAST(len(regexp_extract_all(text, '([a-z]+)ing ')) AS INTEGER) AS n FROM conversations")
def caption_replace_regex(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    find = "([a-z]+)ing "
    return rows.select("conv_id", "turn", names.replace_text(F.col("text"), find, r"\1ed ", True).alias("text"), names.count_matches(F.col("text"), find, True).alias("n"))


@query("SELECT doc_id, source, CAST(regexp_extract(source, '[0-9]+$') AS INTEGER) AS number, rank() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+$') AS INTEGER)) AS natural_rank FROM documents")
def natural_sort_rank(spark, sf_dir):
    """src2 before src10: keys are ranked by how many documents lie before them, then documents get their source's rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sources = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("key", names.natural_key(F.col("source")))
    keys = tables.global_before(sources.groupBy("key").agg(F.sum("n").alias("n")), ["key"], F.col("n"), "before")
    ranked = sources.join(keys.select("key", "before"), "key").select("source", (F.col("before") + 1).alias("natural_rank"))
    number = F.regexp_extract("source", "[0-9]+$", 0).cast("int").alias("number")
    return docs.join(ranked, "source").select("doc_id", "source", number, "natural_rank")


@query("SELECT page_id, CASE WHEN starts_with(p, '/in/') THEN '/out' || substring(p, 4) ELSE '/out/' || regexp_extract(p, '[^/]*$') END AS out FROM (SELECT page_id, '/in/' || regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/[^/]*$', '') || '/' || page_id || '.webp' AS p FROM pages)")
def plan_output_mirror(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    place = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/[^/]*$", "")
    path = F.concat(F.lit("/in/"), place, F.lit("/"), F.col("page_id").cast("string"), F.lit(".png"))
    return pages.select("page_id", names.planned_output(path, F.lit("/in"), F.lit("/out"), "mirror", F.lit(".webp")).alias("out"))


TIMES = [("",), ("90",), ("1:30",), ("01:02:03",), ("x",), ("1:xx",), ("2.5",), ("0:0:1.5",)]


@query(
    f"""WITH t AS (SELECT text FROM {sql_values(TIMES, 'text')} UNION ALL SELECT (l_linenumber || ':' || CAST(l_quantity AS INTEGER)) FROM lineitem),
p AS (SELECT text, list_transform(string_split(trim(text), ':'), lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM t)
SELECT text, CASE WHEN trim(text) = '' THEN NULL WHEN len(v) = 1 THEN v[1] WHEN len(v) = 2 THEN v[1] * 60 + v[2] ELSE (v[1] * 60 + v[2]) * 60 + v[3] END AS seconds FROM p"""
)
def parse_times(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("text"))
    return inline(spark, TIMES, "text string").unionAll(made).select("text", numbers.parse_time(F.col("text")).alias("seconds"))


@query(
    """SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN '--:--' WHEN floor(value * 60) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(floor(value * 60) / 3600) AS BIGINT), CAST(floor(floor(value * 60) / 60) AS BIGINT) % 60, CAST(floor(value * 60) AS BIGINT) % 60)
ELSE printf('%d:%02d', CAST(floor(floor(value * 60) / 60) AS BIGINT), CAST(floor(value * 60) AS BIGINT) % 60) END AS duration FROM events"""
)
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.format_duration(F.col("value") * 60).alias("duration"))


RATES = [("30000/1001",), ("25",), ("0/0",), ("x/2",), ("",), ("29.97",), ("24/1",), ("5/",)]


@query(f"SELECT event_id, rate, coalesce(CASE WHEN contains(rate, '/') THEN CASE WHEN TRY_CAST(split_part(rate, '/', 2) AS DOUBLE) <> 0 THEN TRY_CAST(split_part(rate, '/', 1) AS DOUBLE) / TRY_CAST(split_part(rate, '/', 2) AS DOUBLE) END ELSE TRY_CAST(rate AS DOUBLE) END, 0) AS fps FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN rate ELSE (event_id % 5000) || '/' || (user_id % 7) END AS rate FROM events JOIN {numbered(RATES, 'rate')} ON i = event_id % {len(RATES)})")
def parse_fps(spark, sf_dir):
    """Frames a second from a fraction or a number; 0 for what is neither."""
    made = F.concat((F.col("event_id") % 5000).cast("string"), F.lit("/"), (F.col("user_id") % 7).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, dealt([r for (r,) in RATES], "event_id")).otherwise(made).alias("rate"))
    return rows.select("event_id", "rate", numbers.parse_rate(F.col("rate")).alias("fps"))


HEADING = r"^([0-9]+(\.[0-9]+)*\.? +)?(the|der|die|la|le|in|and)([ ,.]|$)"


@query(f"SELECT doc_id, ln, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents) WHERE length(line) < 80 AND regexp_matches(line, '(?i){HEADING}')")
def section_headings(spark, sf_dir):
    """Short lines that look like a heading; the words are those frequent in the data."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.where((F.length("line") < 80) & F.col("line").rlike("(?i)" + HEADING)).select("doc_id", F.col("ln").cast("long").alias("ln"), "line")


LEAKY = ["author", "charset", "gps", "software"]


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<a [^>]*href=')) AS links,
regexp_matches(html, '(?i)<script') AS has_script, array_to_string(list_filter(['author','charset','gps','software'], lambda k: contains(html, '<meta ' || k || '=')), ',') AS leaky FROM pages"""
)
def page_metadata(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    leaky = F.array_compact(F.array(*[F.when(F.contains("html", F.lit(f"<meta {k}=")), k) for k in LEAKY]))
    return table(spark, sf_dir, "pages").select("page_id", count("<p[ >]").alias("paragraphs"), count("<li[ >]").alias("items"), count("<a [^>]*href=").alias("links"), F.col("html").rlike("(?i)<script").alias("has_script"), F.array_join(leaky, ",").alias("leaky"))


JSON_ROWS = [('{"id": "v1", "items": [{"id": "a", "t": "one"}, {"id": "b", "t": "two"}, {"id": "a", "t": "three"}]}',), ('{"id": "v2", "items": []}',), ("{}",)]


@query(
    f"""WITH r AS (SELECT json FROM {sql_values(JSON_ROWS, 'json')}), e AS (SELECT json_extract_string(json, '$.id') AS list_id, unnest(from_json(json_extract(json, '$.items'), '[{{"id":"VARCHAR","t":"VARCHAR"}}]')) AS item, generate_subscripts(from_json(json_extract(json, '$.items'), '[{{"id":"VARCHAR","t":"VARCHAR"}}]'), 1) AS i FROM r)
SELECT list_id, item.id AS item_id, arg_min(item.t, i) AS title FROM e GROUP BY 1, 2 UNION ALL SELECT 'events', CAST(json_extract(props, '$.k') AS VARCHAR), CAST(min(event_id) AS VARCHAR) FROM events GROUP BY 2"""
)
def embedded_json_walk(spark, sf_dir):
    """Items nested in JSON text, the first of each id; and the first event of each key in props."""
    rows = inline(spark, JSON_ROWS, "json string").select(F.from_json("json", "id string, items array<struct<id:string,t:string>>").alias("j"))
    items = rows.select(F.col("j.id").alias("list_id"), F.posexplode("j.items").alias("i", "item"))
    first = items.groupBy("list_id", F.col("item.id").alias("item_id")).agg(F.min_by("item.t", "i").alias("title"))
    events = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("item_id")).agg(F.min("event_id").cast("string").alias("title"))
    return first.unionByName(events.select(F.lit("events").alias("list_id"), "item_id", "title"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
v AS (SELECT conv_id, i, 0 AS k, '.meta.id' AS path, 'id' AS name, 'c' || (conv_id % 7) || '-' || turn % 3 AS value FROM t UNION ALL SELECT conv_id, i, 1, '.meta.by.role', 'role', role FROM t
  UNION ALL SELECT conv_id, i, 2, '.meta.by["size of"][0]', 'size of', CAST(n AS VARCHAR) FROM t UNION ALL SELECT conv_id, i, 3, '.meta.by["size of"][1][0].half', 'half', CAST(n // 2 AS VARCHAR) FROM t)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, k) - 1 AS ord, '$.turns[' || i || ']' || path AS path, name, value FROM v"""
)
def json_leaves(spark, sf_dir):
    """Every value of JSON that stands in the script of a page for each conversation, whatever its depth."""
    return conversation_leaves(spark, sf_dir).select("conv_id", "ord", "path", "name", "value")


@query(
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
SELECT conv_id, 'c' || (conv_id % 7) || '-' || turn % 3 AS id, min(i) * 4 AS ord FROM t GROUP BY 1, 2"""
)
def json_first_ids(spark, sf_dir):
    """Where each id stands first in the JSON of a conversation's page."""
    return jsonwalk.first_of_each(conversation_leaves(spark, sf_dir), "conv_id", "id").select("conv_id", "id", "ord")


def conversation_leaves(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    one = lambda t: F.concat(
        F.lit('{"meta": {"id": "c'), (F.col("conv_id") % 7).cast("string"), F.lit("-"), (t["turn"] % 3).cast("string"), F.lit('", "by": {"role": "'), t["role"],
        F.lit('", "size of": ['), F.length(t["text"]).cast("string"), F.lit(', [{"half": '), F.floor(F.length(t["text"]) / 2).cast("string"), F.lit("}]]}}}"),
    )
    pages = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # the turns of one conversation
    html = F.concat(F.lit("<html><style>p{margin:0}</style><script>var data = {\"turns\": ["), F.array_join(F.transform("t", one), ", "), F.lit("]};</script><p>{not json}</p></html>"))
    return jsonwalk.walk(pages.select("conv_id", html.alias("html")), "conv_id", "html", "data\\s*=")
