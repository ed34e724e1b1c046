"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words: lower case, ASCII white space squeezed. Two lines are the same if their words are; lines of at least
LEAST_WORDS words are also the same if one word inserted, deleted or replaced makes one the other. A line goes if the
same line, in either sense, first occurs earlier, even if that one goes itself. Earlier is by place: doc_id (null first),
then a hash of the row's text for rows that share a doc_id, then line number.

Each line has one hashed key for each word deleted, and one for itself. Keys are XORs of hashes of (word, position), so
all n of them come from running XORs in linear time. Equal keys make candidates, which are then compared word by word.

Only lines that can have a neighbour get that far: with one word changed, the first or the second half of the line is
as it was. Halves are hashed for all lines first, and lines that share none with another line are left out. The hashes
of the two halves together are also what a line is known by.

No group is paired out. Lines that share a key with the same word replaced are all neighbours of each other, so its
earliest line answers for all; a line and those with one word more are compared with the earliest of the other kind.
Joins go through meet(), which splits keys that hold many rows off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, is_small, meet, save

LEAST_WORDS = 8
FIRST_ID = -(2**63)
PLACE = ("k", "h", "ln")


def normal(text: Column) -> Column:
    """Lower case, with one blank for every run of white space within a line; most texts need only the first."""
    uneven = F.contains(text, F.lit("  ")) | text.rlike(r"[\t\x0B\f\r]")
    return F.lower(F.when(uneven, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\x0B\f\r\n]")


def with_row_key(docs: DataFrame) -> list[Column]:
    """(k, h): rows of one doc_id are told apart by their texts."""
    own = F.col("doc_id").cast("long")
    return [F.coalesce(own, F.lit(FIRST_ID)).alias("k"), F.xxhash64(own, F.col("text").cast("string")).alias("h")]


def lines(docs: DataFrame) -> DataFrame:
    """(k, h, ln, n, head, tail, extra): all lines with any word; docs has k, h and text.

    A line of n words is cut behind floor(n / 2) words; head and tail hash the two parts. Of two lines with one word
    changed, inserted or deleted, one part equals a part of the other, cut as for its own or its neighbour's length;
    where these cuts differ, extra is the other one.
    """
    rows = docs.where("text IS NOT NULL").select("k", "h", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("ln", "s"))
    rows = rows.select("k", "h", "ln", F.trim("s").alias("s")).where("s != ''")
    n = (F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1).alias("n")
    rows = rows.select("k", "h", "ln", "s", n)
    half = F.shiftright("n", 1)
    even = F.col("n") % 2 == 0
    extra = F.when(F.col("n") >= LEAST_WORDS, F.xxhash64(F.when(even, 1).otherwise(2), F.call_function("substring_index", "s", F.lit(" "), F.when(even, half - 1).otherwise(-half))))
    head = F.xxhash64(F.lit(1), F.call_function("substring_index", "s", F.lit(" "), half))
    tail = F.xxhash64(F.lit(2), F.call_function("substring_index", "s", F.lit(" "), half - F.col("n")))
    return rows.select("k", "h", "ln", "n", head.alias("head"), tail.alias("tail"), extra.alias("extra"))


def flags(gone: Column, n: Column) -> Column:
    """From ascending line numbers, whether each of the n lines is among them; in linear time."""
    runs = F.transform(gone, lambda x, j: F.concat(F.array_repeat(F.lit(False), (x - F.when(j > 0, gone[j - 1]).otherwise(-1) - 1).cast("int")), F.array(F.lit(True))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), (n - gone[F.size(gone) - 1] - 1).cast("int")))


def duplicates(docs: DataFrame) -> DataFrame:
    """(k, h, ln) of all lines that go; docs has k, h and text."""
    at = F.struct(*PLACE)
    line = ["head", "tail"]
    found = save(lines(docs), "lines")
    kinds = found.groupBy(*line).agg(F.min(at).alias("first"), F.max("n").alias("n"), F.max("extra").alias("extra"), F.count("*").alias("c"))
    kinds = save(kinds, "kinds")

    long = kinds.where(F.col("n") >= LEAST_WORDS)
    halves = save(long.select(F.explode(F.array("head", "tail", "extra")).alias("half"), "first"), "halves")
    shared = save(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    alive = meet(halves, shared, ["half"]).groupBy("first.k", "first.h").agg(F.collect_set("first.ln").alias("alive"))  # at most the lines of a document
    alive = save(alive, "alive")
    texts = docs.where("text IS NOT NULL")
    own = texts.join(F.broadcast(alive) if is_small(alive, SMALL, F.size("alive")) else alive, ["k", "h"])
    own = own.select("k", "h", F.split("text", "\n").alias("all"), F.array_sort("alive").alias("alive"))
    marked = F.zip_with("all", flags(F.col("alive"), F.size("all")), lambda x, it: F.when(it, x))
    own = own.select("k", "h", F.explode(F.arrays_zip(F.col("alive").alias("ln"), F.array_compact(marked).alias("s"))).alias("a"))
    own = own.select("k", "h", F.col("a.ln").alias("ln"), F.split(F.trim(normal(F.col("a.s"))), " ").alias("w"))
    own = save(own.dropDuplicates([*PLACE]), "own")

    xor = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("long")
    hashed = own.select(*PLACE, F.size("w").alias("n"), F.transform("w", lambda x, i: F.xxhash64(x, i)).alias("here"), F.transform("w", lambda x, i: F.xxhash64(x, i - 1)).alias("moved"))
    hashed = hashed.repartition(*PLACE).select(*PLACE, "n", F.aggregate("here", zero, xor).alias("whole"), F.aggregate("moved", zero, xor).alias("moved_all"), F.arrays_zip("here", "moved").alias("z"))
    each = hashed.select(*PLACE, "n", "whole", "moved_all", F.posexplode("z").alias("i", "z")).select(*PLACE, "n", "whole", "moved_all", "i", "z.here", "z.moved")
    past = Window.partitionBy(*PLACE).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # stays where the line's words are
    run = each.withColumns({"so_far": F.bit_xor("here").over(past), "moved_far": F.bit_xor("moved").over(past)})
    deleted = xor(xor(F.col("so_far"), F.col("here")), xor(F.col("moved_all"), F.col("moved_far")))
    swap_key, cut_key = F.xxhash64(F.lit(1), "n", "i", xor(F.col("whole"), F.col("here"))), F.xxhash64(F.col("n") - 1, deleted)
    variants = save(run.select(*PLACE, "i", swap_key.alias("swap"), cut_key.alias("cut"), F.when(F.col("i") == 0, F.xxhash64("n", "whole")).alias("self")), "variants")

    # The replaced word's place is hashed in; a deletion and the line that it equals have one key.
    swap = variants.select(F.col("swap").alias("key"), at.alias("place"))
    least = save(swap.groupBy("key").agg(F.min("place").alias("top"), F.count("*").alias("c")).where("c > 1"), "least")
    swapped = meet(swap, least, ["key"]).where("place > top").select("place", "top", F.lit(-1).alias("i"), F.lit(False).alias("is_longer"))

    shorter = variants.where("self IS NOT NULL").select(F.col("self").alias("key"), at.alias("short"))
    longer = variants.select(F.col("cut").alias("key"), at.alias("place"), "i")
    top = longer.groupBy("key").agg(F.min(F.struct("place", "i")).alias("t"), F.count("*").alias("c"))
    pairs = save(top.join(shorter, "key"), "shorter")
    shrunk = pairs.where("t.place < short").select(F.col("short").alias("place"), F.col("t.place").alias("top"), F.col("t.i").alias("i"), F.lit(False).alias("is_longer"))
    grown = meet(longer, pairs.select("key", "short", "c"), ["key"]).where("short < place").select("place", F.col("short").alias("top"), "i", F.lit(True).alias("is_longer"))

    text = own.select(at.alias("place"), "w")
    both = save(swapped.unionByName(shrunk).unionByName(grown).distinct(), "pairs")
    tops = save(both.groupBy("top").agg(F.count("*").alias("c")).join(text.withColumnsRenamed({"place": "top", "w": "v"}), "top"), "tops")
    both = meet(both, tops, ["top"], wide=F.size("v")).join(text, "place")
    differ = F.size(F.filter(F.zip_with("w", "v", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    long_, short_ = F.when(F.col("is_longer"), F.col("w")).otherwise(F.col("v")), F.when(F.col("is_longer"), F.col("v")).otherwise(F.col("w"))
    fits = F.concat(F.slice(long_, 1, F.col("i")), F.slice(long_, F.col("i") + 2, F.size(long_))) == short_
    near = both.where(F.when(F.col("i") < 0, (F.size("w") == F.size("v")) & (differ <= 1)).otherwise(fits)).select(F.col("place").alias("first")).distinct()
    near = save(near, "near")

    again = kinds.where("c > 1").join(near, "first", "left_anti").select(*line, "first", "c")
    once = near.join(kinds, "first").select(*line, F.lit(None).cast(kinds.schema["first"].dataType).alias("first"), "c")
    gone = save(again.unionByName(once), "gone")
    return meet(found.select(*PLACE, *line), gone, line).where(F.col("first").isNull() | (F.col("first") != at)).select(*PLACE)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with two more columns, n_lines and n_removed, and in `text` only the lines that stay.

    Null text stays null (0 lines); blank lines always stay and count as lines. Rows with null doc_id come before all
    others. Rows that share a doc_id (or have none) but not the text are documents of their own, in order of a hash of
    their texts; rows that repeat both are one document and lose the same lines. An empty table stays empty.
    Other columns are kept as they are, but for columns named n_lines or n_removed, which are replaced.
    """
    texts = docs.select(*with_row_key(docs), F.col("text").cast("string").alias("text"))
    gone = duplicates(texts).groupBy("k", "h").agg(F.array_sort(F.collect_set("ln")).alias("gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "text")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"), *with_row_key(docs))
    both = row.join(gone, ["k", "h"], "left").select("row", "text", F.split("text", "\n").alias("all"), "gone")
    marked = F.zip_with("all", flags(F.col("gone"), F.size("all")), lambda x, out: F.struct(x.alias("x"), out.alias("out")))
    left = F.array_join(F.transform(F.filter(marked, lambda m: ~m["out"]), lambda m: m["x"]), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")
    out = both.select("row", text, count, removed)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", "n_removed")


def keep_some(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a document all of whose lines had occurred before goes, one that had none stays."""
    done = dedup(docs)
    return done.where((F.col("n_removed") == 0) | ~is_blank(F.col("text"))).select(*[f"`{c}`" for c in docs.columns])


ORACLE = f"""
WITH rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
ws AS (SELECT doc_id, ln, line, list_filter(regexp_split_to_array(lower(line), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM rows),
occ AS (SELECT doc_id, ln, w, array_to_string(w, ' ') AS id, len(w) AS n FROM ws WHERE len(w) > 0),
kinds AS (SELECT id, any_value(w) AS w, any_value(n) AS n, min(doc_id::HUGEINT * 4294967296 + ln) AS pos FROM occ GROUP BY id),
each AS (SELECT id, n, pos, w, unnest(range(1, n + 1)) AS i FROM kinds WHERE n >= {LEAST_WORDS}),
var AS (SELECT id, n, pos, i, array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ') AS key FROM each),
swap AS (SELECT n, i, key, min(pos) AS pos FROM var GROUP BY n, i, key),
longer AS (SELECT n - 1 AS n, key, min(pos) AS pos FROM var GROUP BY n - 1, key),
near AS (
  SELECT v.id FROM var v JOIN swap s ON v.n = s.n AND v.i = s.i AND v.key = s.key AND s.pos < v.pos
  UNION SELECT k.id FROM kinds k JOIN longer l ON k.id = l.key AND k.n = l.n AND l.pos < k.pos WHERE k.n >= {LEAST_WORDS}
  UNION SELECT v.id FROM var v JOIN kinds k ON k.id = v.key AND k.n = v.n - 1 AND k.n >= {LEAST_WORDS} AND k.pos < v.pos),
gone AS (SELECT o.doc_id, o.ln FROM occ o JOIN kinds k ON o.id = k.id LEFT JOIN near x ON x.id = o.id WHERE k.pos <> o.doc_id::HUGEINT * 4294967296 + o.ln OR x.id IS NOT NULL)
SELECT r.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.ln) AS BIGINT) AS n_removed,
  coalesce(string_agg(CASE WHEN g.ln IS NULL THEN r.line END, chr(10) ORDER BY r.ln), '') AS text
FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.ln = g.ln GROUP BY r.doc_id
"""
