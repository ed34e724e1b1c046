"""Cases that every operator must take: ids that are null or repeated, very long texts, names that clash."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
from sluice.llm import jaccard_join, langid, line_dedup, media, packing, periodic, suffix_dedup, token_files, toxicity, tree_bpe, winnowing
from test_jaccard import plain_components
from test_suffix import plain as plain_strings

SCHEMA = "doc_id long, text string, lang string, key string, rank int, row int, label long, gone string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1, 2, 3, "g") for i, t in rows], SCHEMA)


def operators(spark):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    return {
        "langid": langid.predict, "lines": line_dedup.dedup, "suffix": suffix_dedup.digests, "bpe": lambda d: tree_bpe.encode(d, digests=True), "toxicity": lambda d: toxicity.grade(d, marks),
        "packing": packing.pack, "tokens": token_files.round_trip, "media": media.round_trip, "winnowing": winnowing.edited_likeness, "jaccard": jaccard_join.join, "periodic": periodic.find,
    }


NAMES = ["langid", "lines", "suffix", "bpe", "toxicity", "packing", "tokens", "media", "winnowing", "jaccard", "periodic"]


@pytest.mark.parametrize("name", NAMES)
def test_null_and_repeated_ids(spark, name):
    rows = [(None, "a null id with some words in it"), (None, None), (1, "first text of one"), (1, "second text of one"), (2, "same row"), (2, "same row"), (3, ""), (4, None)]
    got = operators(spark)[name](frame(spark, rows)).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    assert ids == sorted((i is None, i or 0) for i, _ in rows)


@pytest.mark.parametrize("name", ["bpe", "media", "periodic"])
def test_values_do_not_depend_on_ids(spark, name):
    rows = [(None, "a null id with some words in it"), (None, None), (1, "first text of one"), (1, "second text of one"), (2, "same row " * 9), (2, "same row " * 9), (3, ""), (4, None)]
    run = operators(spark)[name]
    values = lambda df: sorted(map(repr, df.drop("doc_id").collect()))
    assert values(run(frame(spark, rows))) == values(run(frame(spark, [(i, t) for i, (_, t) in enumerate(rows)])))


def test_values_of_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(200_000)) + " again and" * 5000 + "\n" + "日本語" * 9000
    docs = frame(spark, [(1, long)])
    from sluice.llm.tokens import tokenizer

    ids = np.array(tokenizer("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids, dtype="<u4")
    got = tree_bpe.encode(docs, "byte_bpe_50k.json", digests=True).first()
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(long.encode()).hexdigest())
    stored = media.round_trip(docs).first()
    assert stored.payload_sha256 == hashlib.sha256(media.padded(long.encode())).hexdigest() and stored.n_bytes == len(long.encode())
    runs = periodic.find(docs).first()
    assert runs.n_words == 210_001 and [tuple(r) for r in runs.runs] == [(200_000, 10_000, 2)]


@pytest.mark.parametrize("name", NAMES)
def test_very_long_text(spark, name):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    long = " ".join(words) + "\n" + "x" * 100_000 + "\n" + "日本語" * 30_000
    got = {r.doc_id: r for r in operators(spark)[name](frame(spark, [(1, long), (2, "short"), (3, long[:1000])])).collect()}
    assert set(got) == {1, 2, 3}


def test_repeated_ids_with_unlike_texts(spark):
    base = [f"word{i} other{i * 7 % 13} some{i * 5 % 17}" for i in range(60)]
    a, b = " ".join(base), " ".join(base[:59] + ["changed"])
    rows = [(5, "nothing like the rest of them at all"), (5, a), (6, b), (9, "alone")]
    got = {r.component_id for r in jaccard_join.join(frame(spark, rows)).where("doc_id = 6").collect()}
    assert got == {5} and plain_components([(1, a), (6, b)], 4, 85, 100)[6][1] == 1
    shared = "z" * 60
    rows = [(1, "head " + shared), (2, "q " + shared), (2, "unlike"), (3, shared + " t")]
    kept = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.digests(frame(spark, rows)).collect())
    assert kept[0] == (1, 0) and kept[-1] == (3, 60) and max(k for i, k in kept if i == 2) >= 60
    want = plain_strings([(1, "head " + shared), (3, shared + " t")], 50)
    assert int(np.sum(want[3][1])) == 60


def test_pipeline_runs_its_stages(spark, tmp_path):
    from test_pipeline import corpus

    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), docs.schema)
        assert step.count() > 0
    want = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(step).collect())
    assert got == want and len({i for i, *_ in got}) < 120
    digest = hashlib.sha256(repr(got).encode()).hexdigest()
    again = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert hashlib.sha256(repr(again).encode()).hexdigest() == digest
