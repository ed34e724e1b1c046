"""Ranked search against a plain loop over the catalog."""

import random

import pytest
from sluice.operators import search


def plain(catalog, searches, k):
    out = []
    for key, text in searches:
        phrase = " ".join((text or "").lower().split())
        if not phrase:
            continue
        found = []
        for i, *texts in catalog:
            title, identifier, category, subtitle = ((t or "").lower() for t in texts)
            identifier = identifier.replace("_", " ")
            terms = phrase.split()
            inside = lambda t: all(x in t for x in terms)  # noqa: B023, E731
            if not inside(f"{title} {identifier} {category} {subtitle}"):
                continue
            s = 0 if title == phrase else 1 if title.startswith(phrase) else 2 if inside(title) else 3 if inside(identifier) else 4 if inside(category) else 5
            found.append((s, title, i))
        out += [(key, r, i, s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_equals_a_plain_loop(spark, k, monkeypatch):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    catalog = [(i, " ".join(word() for _ in range(rng.randrange(1, 4))), word() + "_" + word(), rng.choice(["Audio", "ab tools", None]), word() if i % 3 else None) for i in range(120)] + [(500, None, None, None, None), (501, "Same", "x", "y", "z"), (502, "Same", "x", "y", "z")]
    searches = [(i, rng.choice([word(), word() + "  " + word(), word().upper(), catalog[i][1], catalog[i][1][:3]])) for i in range(60)] + [(100, None), (101, "  "), (102, "same"), (103, "nowhere"), (104, "a a a"), (105, "AUDIO\tau"), (106, "zzz a")]
    if k == 3:
        monkeypatch.setattr(search, "FEW", 0)
    index = search.build(spark.createDataFrame(catalog, "id long, title string, identifier string, category string, subtitle string"))
    got = search.best(index, spark.createDataFrame(searches, "search long, text string"), k).collect()
    assert sorted(map(tuple, got)) == plain(catalog, searches, k)


@pytest.mark.parametrize("k", [2, 30])
def test_repeated_texts_and_phrases_count_once(spark, k):
    """Rows of equal texts are one entry, searches for one phrase one lookup; each row and search is in the result."""
    rng = random.Random(9)
    kinds = [(t, i, c, None) for t in ("red ring", "Red Bolt", "bolt") for i in ("x_1", "x_2") for c in ("ring", "big")]
    catalog = [(i, *rng.choice(kinds)) for i in rng.sample(range(1000), 300)]
    searches = [(i, rng.choice(["red", "RING", "bolt  big", "1", "x 2", "none"])) for i in range(50)]
    index = search.build(spark.createDataFrame(catalog, "id long, title string, identifier string, category string, subtitle string"))
    assert index.entries.count() == len({c[1:] for c in catalog}) and index.members.count() == 300
    got = search.best(index, spark.createDataFrame(searches, "search long, text string"), k).collect()
    assert sorted(map(tuple, got)) == plain(catalog, searches, k)


def test_empty_catalog_and_no_searches(spark):
    none = spark.createDataFrame([], "id long, title string, identifier string, category string, subtitle string")
    asked = spark.createDataFrame([(1, "a")], "search long, text string")
    assert search.best(search.build(none), asked, 5).count() == 0
    some = spark.createDataFrame([(1, "a", "b", "c", "d")], none.schema)
    assert search.best(search.build(some), asked.limit(0), 5).count() == 0
