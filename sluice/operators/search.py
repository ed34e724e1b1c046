"""Ranked search in a catalog: an inverted index of grams, and the best matches of each of many searches at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import save

#: Longest gram of the index; a term of fewer letters is a gram itself.
GRAM = 3
#: Searches that are broadcast to the postings; more are shuffled.
FEW = 100_000
FIELDS = ("title", "identifier", "category", "subtitle")


def grams(text: Column) -> Column:
    """All distinct substrings of 1 to GRAM characters."""

    def of(n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


@dataclass
class Index:
    """Saved tables: entries (entry, the four texts in lower case, least id, n), one for all rows of equal texts, members
    (entry, id), postings (gram, titled, entry) and sizes (gram, n)."""

    entries: DataFrame
    members: DataFrame
    postings: DataFrame
    sizes: DataFrame


def build(catalog: DataFrame) -> Index:
    """Indexes a catalog (id, title, identifier, category, subtitle). Null texts are empty; in identifiers `_` counts as a
    blank. Ids should be unique: a repeated id is matched by each of its rows."""
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in FIELDS]
    texts[1] = F.replace(texts[1], F.lit("_"), F.lit(" "))
    rows = catalog.select("id", *[t.alias(c) for t, c in zip(texts, FIELDS, strict=True)])
    entries = save(rows.groupBy(*FIELDS).agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    members = save(rows.join(entries.select("entry", *FIELDS), list(FIELDS)).select("entry", "id"), "members")
    rest = F.concat_ws(" ", *FIELDS[1:])
    each = F.concat(F.transform(grams(F.col("title")), lambda g: F.struct(g.alias("gram"), F.lit(True).alias("titled"))), F.transform(grams(rest), lambda g: F.struct(g.alias("gram"), F.lit(False).alias("titled"))))
    postings = entries.select("entry", F.inline(each)).where("gram NOT RLIKE '\\\\s'").distinct()
    postings = save(postings, "postings")
    return Index(entries, members, postings, save(postings.groupBy("gram").agg(F.count("*").alias("n")), "sizes"))


def score(phrase: Column, terms: Column) -> Column:
    """How well an entry matches, 0 the best: the whole title, its beginning, all terms in the title, in the identifier, in
    the category, or anywhere; null where a term is nowhere."""
    inside = lambda text: F.forall(terms, lambda t: F.contains(text, t))
    found = F.when(F.col("title") == phrase, 0).when(F.startswith("title", phrase), 1)
    for at, name in enumerate(FIELDS[:3], 2):
        found = found.when(inside(F.col(name)), at)
    return found.when(inside(F.concat_ws(" ", *FIELDS)), 5)


def best(index: Index, searches: DataFrame, k: int) -> DataFrame:
    """(search, rank, id, score): for each search (search, text) its k best entries by score, title and id, ranked from 1.
    Every blank-separated term has to be a part of one of an entry's texts. Searches without terms find nothing.

    Each phrase is looked up once, however many searches have it, and each entry once, however many rows have its texts: of
    the k best rows none is of an entry behind the k best entries, entries taken by their least id.

    Of all grams of a phrase's terms the rarest leads to its candidates. Titles are asked first: what is found in other
    texts alone scores 3 at best, so only phrases with fewer than k matches by title go on to these.
    """
    said = searches.select("search", F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")).alias("phrase")).where("phrase <> ''")
    asked = said.select("phrase").distinct().withColumn("terms", F.array_distinct(F.split("phrase", " ")))
    each = asked.select("phrase", F.explode("terms").alias("term"))
    longest = F.filter(grams(F.col("term")), lambda g: F.length(g) == F.least(F.length("term"), F.lit(GRAM)))
    sized = each.select("phrase", F.explode(longest).alias("gram")).distinct().join(index.sizes, "gram", "left")
    rarest = sized.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")), "gram")).alias("top")).select("phrase", F.col("top.gram").alias("gram"))
    asked = save(asked.join(rarest, "phrase"), "asked")

    def found(some: DataFrame, postings: DataFrame) -> DataFrame:
        some = F.broadcast(some) if some.count() <= FEW else some
        candidates = postings.select("gram", "entry").distinct().join(some, "gram")
        scored = candidates.join(index.entries, "entry").withColumn("score", score(F.col("phrase"), F.col("terms")))
        return scored.where("score IS NOT NULL").select("phrase", "score", "title", "least", "entry", "n")

    def first(matches: DataFrame, key: str, *order: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # Spark keeps k a key before it shuffles

    titled = save(first(found(asked, index.postings.where("titled")).where("score <= 2"), "phrase", "score", "title", "least"), "titled")
    done = titled.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    others = save(asked.join(done, "phrase", "left_anti"), "others")
    rest = found(others, index.postings).where("score > 2")
    tops = save(first(titled.drop("rank").unionByName(rest), "phrase", "score", "title", "least").drop("rank"), "tops")
    members = first(index.members.join(tops.select("entry").distinct(), "entry", "left_semi"), "entry", "id").drop("rank")
    matches = first(tops.join(members, "entry"), "phrase", "score", "title", "id").select("phrase", "rank", "id", "score")
    return said.join(save(matches, "matches"), "phrase").select("search", "rank", "id", "score")
