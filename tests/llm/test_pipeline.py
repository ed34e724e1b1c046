import random

import corpus_pipeline
from test_jaccard import plain_components
from test_suffix import plain as plain_strings

WORDS = {"en": [f"en{c}{d}th" for c in "abcdefgh" for d in "klmnop"], "de": [f"sch{c}{d}ung" for c in "abcdefgh" for d in "klmnop"]}


def corpus():
    rng = random.Random(11)
    rows, shared = [], [" ".join(rng.choice(WORDS["en"]) for _ in range(14)) for _ in range(3)]
    for i in range(120):
        lang = rng.choice(["en", "en", "de"])
        lines = [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 1:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if i % 5 == 2 and rows:
            lines = rng.choice(rows)[1].split("\n")
            if i % 2:
                w = lines[0].split(" ")
                w[rng.randrange(len(w))] = rng.choice(WORDS[lang])
                lines[0] = " ".join(w)
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0))
    return [*rows, (200, None, "en", "s", None), (201, "", "en", "s", 0), (202, "12 34 --", "en", "s", 8), (203, rows[3][1], None, None, None)]


def near(a, b):
    """Equal, or long enough and one word apart."""
    if a == b:
        return True
    a, b = sorted((a, b), key=len)
    if len(a) < 8 or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(rows):
    seen, out = [], {}
    for doc_id, text in rows:
        kept = []
        for line in text.split("\n"):
            w = line.lower().split()
            if not w or not any(near(w, s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        if kept:
            out[doc_id] = "\n".join(kept)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_duplicates", "suffix_dedup", "best_fit_packing"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    known = steps["language_id"](spark, docs, None).cache()
    assert set(text(docs)) - set(text(known)) == {200, 201, 202} and known.columns == docs.columns

    lines = steps["line_dedup"](spark, known, None).cache()
    assert text(lines) == plain_lines(sorted(text(known).items())) and lines.columns == docs.columns

    several = known.unionByName(docs.where("doc_id >= 200 AND doc_id < 203"))
    groups = plain_components(sorted(text(several).items()), 5, 8, 10)
    assert set(text(steps["near_duplicates"](spark, several, None))) == {i for i, (_, c) in groups.items() if i == c}
    unlike = steps["near_duplicates"](spark, lines, None)

    cut = steps["suffix_dedup"](spark, several, None)
    want = plain_strings(sorted(text(several).items()), 50)
    kept = {i: bytes(b for b, g in zip(data, gone, strict=True) if not g).decode() for i, (data, gone) in want.items()}
    assert {i: t or "" for i, t in text(cut).items()} == {i: t for i, t in kept.items() if t.strip() or not want[i][1].any()}

    pieces = steps["best_fit_packing"](spark, unlike, None).collect()
    assert {p.doc_id for p in pieces} == set(text(unlike)) and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0
