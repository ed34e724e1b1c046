from functools import partial

from sluice.llm import common, line_dedup
from test_pipeline import corpus, near


def test_against_plain(spark):
    rows = [r[:2] for r in corpus()] + [(300, "one two three four five six seven eight\n\n ONE two  three four five six seven eight\none two three four five six seven eight nine\n" + "x " * 3000)]
    docs = spark.createDataFrame([(i, t, 5, "g") for i, t in rows], "doc_id long, text string, n_lines int, gone string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    seen = []
    for doc_id, text in sorted(rows):
        lines = text.split("\n") if text is not None else []
        kept = []
        for line in lines:
            w = line.lower().split()
            if not w or not any(near(w, s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        r = got[doc_id]
        assert (r.n_lines, r.n_removed) == (len(lines), len(lines) - len(kept))
        assert r.text == (None if text is None else "\n".join(kept))
        assert r.gone == "g"


def test_edges(spark):
    line = "a b c d e f g h"
    docs = spark.createDataFrame([(None, line), (2, line), (2, line), (3, line + " i"), (4, "b c d e f g h"), (5, "a b"), (6, "A  b ")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.text) for r in line_dedup.dedup(docs).collect())
    assert got == [(-1, line), (2, ""), (2, ""), (3, ""), (4, "b c d e f g h"), (5, "a b"), (6, "")]
    assert [r.doc_id for r in line_dedup.keep_some(docs).orderBy("doc_id").collect()] == [None, 4, 5]
    assert line_dedup.dedup(docs.limit(0)).count() == 0
    plan = line_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_rows_that_share_or_lack_an_id(spark):
    rows = [(1, "alpha"), (2, "alpha\nbeta only here"), (2, "gamma unique\ndelta"), (None, "dup\nx1"), (None, "uniq\nx2\nx3"), (None, "q\nx1\ndup\nx1"), (None, "dup\nx1")]
    got = [r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    left = sorted(line for t in set(got) if t for line in t.split("\n") if line)
    assert left == sorted({"alpha", "beta only here", "gamma unique", "delta", "dup", "x1", "uniq", "x2", "x3", "q"})


def test_long_line_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    monkeypatch.setattr(line_dedup, "meet", partial(common.meet, small=0, hot=20))
    words = [f"w{i}" for i in range(20_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:777] + words[778:])), (2, "same line\nsame line")]
    rows += [(10 + i, f"all rights reserved by the holder number {i} and others\nthe very same line of more than eight words\nshort line\nonly {i}") for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == "" and got[2] == "same line"
    assert got[10] == rows[3][1] and all(got[10 + i] == f"only {i}" for i in range(1, 300))


def test_saved_tables_can_be_cleared(spark):
    common.clear(spark)
    line_dedup.dedup(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    kept = list(common.SAVED)
    assert kept and common.clear(spark) == len(kept) and not common.SAVED and common.clear(spark) == 0
