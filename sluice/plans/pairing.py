"""Pairing, sets of files by name, collisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, tables
from .registry import query, table


@query(
    """WITH l AS (SELECT doc_id, doc_id AS d1 FROM documents WHERE lang = 'en'), r AS (SELECT DISTINCT doc_id, doc_id AS d2 FROM labels)
SELECT coalesce(d1, d2) AS doc_id, CASE WHEN d1 IS NULL THEN 'orphan' WHEN d2 IS NULL THEN 'missing' ELSE 'pair' END AS status FROM l FULL OUTER JOIN r ON d1 = d2"""
)
def pair_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.col("doc_id").alias("image"))
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("caption", F.col("doc_id"))
    return tables.pair(docs, labels, "doc_id", "image", "caption").select("doc_id", "status")


@query("SELECT conv_id, turn, text FROM conversations c WHERE role = 'assistant' AND turn = (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'assistant')")
def pair_first_wins(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return tables.first_per(turns, ["conv_id"], ["turn"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def missing_partner(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sidecar_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@query(
    """WITH names AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS stem FROM part), sets AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT stem, arg_max(name, length(name)) AS set_name, count(*) AS candidates FROM names JOIN sets ON stem = name OR starts_with(stem, name || ' ') GROUP BY stem"""
)
def longest_prefix_set(spark, sf_dir):
    """Each name belongs to the longest set name that is a prefix of it at a blank: an equi-join on its prefixes."""
    part = table(spark, sf_dir, "part")
    stems = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("stem")).distinct()
    sets = part.select(F.col("p_name").alias("name")).union(part.select(F.substring_index("p_name", " ", 1))).distinct()
    words = F.split("stem", " ")
    prefixes = stems.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("name"))
    return prefixes.join(sets, "name").groupBy("stem").agg(F.max_by("name", F.length("name")).alias("set_name"), F.count("*").alias("candidates"))


TOKENS = ["ring", "widget", "gear", "bolt"]


@query("SELECT p_partkey, CAST(list_position(['ring','widget','gear','bolt'], regexp_extract(p_name, '[a-z]+$')) AS INTEGER) AS rank FROM part WHERE list_contains(['ring','widget','gear','bolt'], regexp_extract(p_name, '[a-z]+$'))")
def base_token_rank(spark, sf_dir):
    last = F.regexp_extract("p_name", "[a-z]+$", 0)
    place = F.array_position(F.array(*map(F.lit, TOKENS)), last).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("rank")).where("rank > 0")


OUT_SQL = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')"


@query(f"SELECT out, page_id, n FROM (SELECT {OUT_SQL} AS out, page_id, count(*) OVER (PARTITION BY {OUT_SQL}) AS n FROM pages) WHERE n > 1")
def output_collisions(spark, sf_dir):
    """Pages that would be written under a name that others have too."""
    out = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0)
    return tables.collisions(table(spark, sf_dir, "pages"), out, F.col("page_id")).select("out", F.col("source").alias("page_id"), "n")


@query("SELECT page_id, CASE WHEN k = 0 THEN s || '.html' ELSE printf('%s_%03d.html', s, CAST(k AS INTEGER)) END AS out FROM (SELECT page_id, s, row_number() OVER (PARTITION BY s ORDER BY page_id) - 1 AS k FROM (SELECT page_id, " + OUT_SQL + " AS s FROM pages))")
def rename_collisions(spark, sf_dir):
    """Equal planned names are numbered in order of the page."""
    from ..functions.names import numbered

    stems = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0).alias("s"))
    ranked = tables.rank_within(stems, ["s"], ["page_id"], "k")
    return ranked.select("page_id", numbered(F.col("s"), F.col("k"), F.lit(".html")).alias("out"))


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_type, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay FROM part)
SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') THEN 2 WHEN contains(lower(p_type), 'red') THEN 4 ELSE 5 END AS INTEGER) AS score
FROM t WHERE contains(hay, 'red') AND contains(hay, 'ring')"""
)
def ranked_search(spark, sf_dir):
    """All terms of 'red ring' must occur; better kinds of matches have lower scores."""
    part = table(spark, sf_dir, "part")
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    name = F.lower(F.col("p_name"))
    terms = ["red", "ring"]
    score = F.when(name == " ".join(terms), 0).when(name.startswith(terms[0]), 1).when(name.contains(terms[0]) | name.contains(terms[1]), 2).when(F.lower("p_type").contains(terms[0]), 4).otherwise(5)
    return part.where(hay.contains(terms[0]) & hay.contains(terms[1])).select("p_partkey", score.cast("int").alias("score"))


SEARCHES = "SELECT p_partkey AS search, upper(split_part(p_name, ' ', 2)) || '  ' || substring(p_type, 1, 1 + p_partkey // 100 % 3) AS text FROM part WHERE p_partkey % 100 = 0 AND p_partkey % 300 <> 0 UNION ALL SELECT p_partkey, substring(p_name, 1, 4) FROM part WHERE p_partkey % 300 = 0"


@query(
    f"""WITH s AS ({SEARCHES}), q AS (SELECT search, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS phrase FROM s),
e AS (SELECT p_partkey AS id, lower(p_name) AS title, lower(p_brand) AS identifier, lower(p_type) AS category, 'size ' || p_size AS subtitle FROM part),
m AS (SELECT search, id, title, CASE WHEN title = phrase THEN 0 WHEN starts_with(title, phrase) THEN 1 WHEN len(list_filter(terms, lambda t: NOT contains(title, t))) = 0 THEN 2 WHEN len(list_filter(terms, lambda t: NOT contains(identifier, t))) = 0 THEN 3
  WHEN len(list_filter(terms, lambda t: NOT contains(category, t))) = 0 THEN 4 WHEN len(list_filter(terms, lambda t: NOT contains(title || ' ' || identifier || ' ' || category || ' ' || subtitle, t))) = 0 THEN 5 END AS score FROM (SELECT *, string_split(phrase, ' ') AS terms FROM q) CROSS JOIN e)
SELECT search, row_number() OVER (PARTITION BY search ORDER BY score, title, id) AS rank, id, score FROM m WHERE score IS NOT NULL QUALIFY rank <= 25"""
)
def search_best(spark, sf_dir):
    """For searches made from every hundredth part, the 25 best matches among all parts."""
    part = table(spark, sf_dir, "part")
    chosen = part.where("p_partkey % 100 = 0")
    pair = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("  "), F.substring("p_type", F.lit(1), F.expr("CAST(1 + p_partkey DIV 100 % 3 AS INT)")))
    text = F.when(F.col("p_partkey") % 300 != 0, pair).otherwise(F.substring("p_name", 1, 4))
    catalog = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("identifier"), F.col("p_type").alias("category"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("subtitle"))
    found = search.best(search.build(catalog), chosen.select(F.col("p_partkey").alias("search"), text.alias("text")), 25)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT p_brand AS category, count(*) AS n, min(lower(p_name)) AS first_title FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#99') GROUP BY 1 UNION ALL SELECT c, 0, NULL FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#99')) AS t(c) WHERE c NOT IN (SELECT p_brand FROM part)")
def category_listing(spark, sf_dir):
    """Titles of the asked categories; a category that nothing has is listed with none."""
    asked = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#99",)], "category string")
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"), F.min(F.lower("p_name")).alias("first_title"))
    return asked.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "first_title")


@query("WITH top AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) SELECT o_orderkey, count(l_orderkey) AS items, coalesce(CAST(sum(l_quantity) AS DOUBLE), 0) AS quantity FROM top LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def top_history(spark, sf_dir):
    """The latest 20 orders with their items."""
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    both = lines.join(F.broadcast(top), "o_orderkey", "right")  # 20 rows
    return both.groupBy("o_orderkey").agg(F.count("l_quantity").alias("items"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("quantity"))
