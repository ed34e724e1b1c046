import random
from collections import Counter
from zlib import crc32

import numpy as np
from sluice.llm import langid, toxicity

WORDS = {"en": "the of and to in that is was with for on this".split(), "de": "der die und ein ist das nicht mit auf für sich".split(), "fr": "le la les et des une est que pour dans qui".split()}


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 40))), lang, i % 7))
    return rows


def test_language(spark):
    rows = corpus() + [(1000, None, "en", 1), (1001, "", None, 1), (1002, "12 -- 9", "de", 1), (None, "the of and", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.predict(docs).collect()
    assert len(got) == len(rows)
    by, right, n = {r.doc_id: r for r in got}, 0, 0
    for doc_id, text, lang, _ in rows[:-4]:
        r = by[doc_id]
        assert r.held_out == (crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            n += 1
            right += r.lang_pred == lang
    assert right / n > 0.95
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    assert langid.predict(docs.limit(0)).count() == 0


def test_l1_gives_zeros():
    leader = langid.FollowTheLeader(50, 2, l1=1.0)
    rng = np.random.default_rng(0)
    for _ in range(300):
        y = rng.integers(2)
        nz = np.array([y, 10 + rng.integers(40)])
        w = leader.weights(nz)
        p = langid.softmax(w.sum(axis=0))
        p[y] -= 1
        leader.step(nz, w, np.repeat(p[None], 2, axis=0))
    w = leader.weights()
    assert (w[2:10] == 0).all() and w[0, 0] > 0 > w[1, 0] and (w[10:] == 0).mean() > 0.3


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i, (doc_id, text, _, _) in enumerate(corpus(400, 8)):
        toxic, good = i % 6 == 0, i % 2
        if toxic:
            words = text.split()
            for _ in range(3 if good else 6):
                words.insert(rng.randrange(len(words)), rng.choice(["foul", "vile"] if good else ["vile", "grim"]))
            text = " ".join(words)
        rows.append((doc_id, text))
        labels.append((doc_id, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.grade(docs, marks).collect()}
    assert len(got) == 402 and not got[900].toxic and not got[901].toxic
    for doc_id, _, toxic in labels[300:]:
        assert got[doc_id].toxic == bool(toxic) and 0 <= got[doc_id].severity <= 2
    assert toxicity.grade(docs.limit(0), marks).count() == 0
    assert not any(r.toxic for r in toxicity.grade(docs, marks.limit(0)).collect())


def test_toxic_text_in_a_third_of_the_rows(spark):
    """Words of a text with many copies count like others: the copies are toxic, empty texts are not."""
    bad = "grim foul vile the of and to"
    rows = [(i, bad if i % 3 == 0 else t) for i, (_, t, _, _) in enumerate(corpus(600, 5))]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "the of foul to")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(450)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.grade(docs, marks).collect()}
    assert all(got[i].toxic == (i % 3 == 0) for i in range(600))
    assert not got[900].toxic and not got[901].toxic and got[902].severity > got[901].severity


def test_rare_toxic_words_in_a_large_table(spark):
    """A word of five labelled documents counts, however many others there are."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 6000 = 7 THEN 'foul vile' ELSE concat('word', chr(CAST(97 + id % 20 AS INT))) END AS text")
    marks = spark.range(30_000).selectExpr("id AS doc_id", "0 AS quality", "CAST(id % 6000 = 7 AS INT) AS toxic")
    got = toxicity.grade(docs, marks)
    severity = {r.bad: r.s for r in got.groupBy((got.doc_id % 6000 == 7).alias("bad")).agg({"severity": "avg"}).toDF("bad", "s").collect()}
    assert severity[True] > 10 * severity[False]


def test_likelihood_against_differences():
    """The slopes of the cumulative-link likelihood are those that differences show, and grades' chances add up to 1."""
    rng = np.random.default_rng(12)
    for _ in range(40):
        s, first, gaps = rng.normal(0, 2), rng.normal(1, 1), rng.normal(0, 1, toxicity.GRADES - 2)
        loss = lambda s, first, gaps, y: -np.log(toxicity.likelihood(s, y, first, gaps)[0])
        chances = [toxicity.likelihood(s, y, first, gaps)[0] for y in range(toxicity.GRADES)]
        assert abs(sum(chances) - 1) < 1e-9
        for y in range(toxicity.GRADES):
            _, by_score, by_edges = toxicity.likelihood(s, y, first, gaps)
            h = 1e-5
            assert abs((loss(s + h, first, gaps, y) - loss(s - h, first, gaps, y)) / (2 * h) - by_score) < 1e-4
            assert abs((loss(s, first + h, gaps, y) - loss(s, first - h, gaps, y)) / (2 * h) - by_edges[0]) < 1e-4
            for j in range(len(gaps)):
                step = np.eye(len(gaps))[j] * h
                assert abs((loss(s, first, gaps + step, y) - loss(s, first, gaps - step, y)) / (2 * h) - by_edges[1 + j]) < 1e-4


def test_slopes_of_many_scores():
    rng = np.random.default_rng(2)
    s, y = rng.normal(0, 2, 50), rng.integers(0, toxicity.GRADES, 50)
    first, gaps = 0.3, rng.normal(0, 1, toxicity.GRADES - 2)
    one = [toxicity.likelihood(a, int(b), first, gaps) for a, b in zip(s, y, strict=True)]
    by_score, by_edges = toxicity.slopes(s, y, first, gaps)
    assert np.allclose(by_score, [o[1] for o in one]) and np.allclose(by_edges, np.mean([o[2] for o in one], axis=0))


def test_telling_words_and_cuts(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_FALSE", 1.0)
    rows = [np.array(r) for r in ([1, 5], [1, 6], [1, 2, 7], [1, 2, 8], [2, 9], [2], [2, 3], [2, 3], [2], [2])]
    toxic = np.array([True] * 4 + [False] * 6)
    assert np.flatnonzero(toxicity.telling(rows, toxic)).tolist() == [1]  # 5 to 8 are of one document each, 2 and 3 of clean ones
    scores = np.array([3.0, 2.0, 2.0, 1.0, 0.5, 0.0])
    f1, cut = toxicity.best_cut(scores, np.array([True, True, False, True, False, False]))
    plain = {c: 2 * sum(t for x, t in zip(scores, [1, 1, 0, 1, 0, 0], strict=True) if x > c) / ((scores > c).sum() + 3) for c in (2.5, 1.5, 0.75, 0.25, -1)}
    assert cut == max(plain, key=plain.get) and f1 == max(plain.values())
    monkeypatch.setattr(toxicity, "MOST_FALSE", 0.005)
    assert toxicity.best_cut(scores, np.array([True, True, False, True, False, False]))[1] == 2.5
    w, thresholds = toxicity.fit_sample([(int(t) * (1 + i % 2), r) for i, (r, t) in enumerate(zip(rows * 6, list(toxic) * 6, strict=True))])
    assert thresholds[0] < thresholds[1] and all((w[r].sum() > thresholds[0]) == t for r, t in zip(rows, toxic, strict=True))


def test_toxicity_on_held_out_labels(spark):
    """Halves of the driver's labels that the model has not seen, with few toxic documents to learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for seed in (1, 2):
        half = labels.selectExpr("*", f"pmod(xxhash64({seed}, doc_id), 2) AS half")
        model = toxicity.fit(docs, half.where("half = 0"))
        asked = docs.join(half.where("half = 1").select("doc_id", "toxic"), "doc_id")
        got = toxicity.grade(asked.select("doc_id", "text"), labels, model).withColumnRenamed("toxic", "found").join(asked.select("doc_id", "toxic"), "doc_id").collect()
        toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
        assert sum(r.found for r in toxic) / len(toxic) >= 0.7 and sum(r.found for r in clean) / len(clean) < 0.01


def test_leader_against_one_weight_at_a_time():
    rng = np.random.default_rng(3)
    leader = langid.FollowTheLeader(6, 1, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = [0.0] * 6, [0.0] * 6

    def weight(i):
        if abs(z[i]) <= 0.1:
            return 0.0
        return -(z[i] - (0.1 if z[i] > 0 else -0.1)) / ((1 + n[i] ** 0.5) / 0.5 + 0.2)

    for _ in range(200):
        rows, g = np.unique(rng.integers(0, 6, 3)), float(rng.normal())
        w = leader.weights(rows)
        assert np.allclose(w[:, 0], [weight(i) for i in rows])
        for i in rows:
            new = n[i] + g * g
            z[i] += g - (new**0.5 - n[i] ** 0.5) / 0.5 * weight(i)
            n[i] = new
        leader.step(rows, w, np.full((len(rows), 1), g))


def test_grams_weights_and_temperature():
    text = "Der Fuß, 12 där! der"
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    want = [plain[i : i + k] for k in (1, 2, 3) for i in range(len(plain) - k + 1) if not (k == 1 and plain[i] == " ")]
    nz, n = langid.counts(text)
    assert n.sum() == len(want) and sorted(n.tolist()) == sorted(Counter(want).values())
    idf = np.linspace(1, 2, langid.BUCKETS)
    x = langid.weigh((nz, n), idf)
    assert abs(x @ x - 1) < 1e-12 and np.allclose(x / x[0], (1 + np.log(n)) * idf[nz] / ((1 + np.log(n[0])) * idf[nz[0]]))
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 1, (400, 3)) + 1.5 * np.eye(3)[y]
    found = langid.temperature(10 * logits, y)
    loss = lambda t: -np.log(langid.softmax(10 * logits / t)[np.arange(400), y]).mean()
    assert loss(found) <= min(loss(t) for t in np.linspace(1, 20, 100)) + 1e-3 and 3 < found < 20


def test_ties_repeats_and_clashing_names(spark):
    rows = [(i % 50, t, lang, 1, "x") for i, t, lang, _ in corpus(200, 2)] + [(7, "the of and to in that", None, 1, "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, grade string")
    got = langid.predict(docs).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 7}) < 40
    marks = spark.createDataFrame([(i % 50, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    assert toxicity.grade(docs, marks).count() == len(rows)
