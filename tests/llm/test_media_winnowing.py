import hashlib
import random
import zlib

from functools import partial

from sluice.llm import common, media, winnowing


def test_chunks_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(len(p) <= media.MOST for p in parts) and all(len(p) >= media.LEAST for p in parts[:-1])
    moved = media.chunks(b"some bytes before" + data)
    assert len(set(parts) & set(moved)) > len(parts) // 2
    assert b"".join(media.chunks(bytes(100_000))) == bytes(100_000)


def test_media_round_trip(docs, spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    more = [(100, body), (101, "x" + body), (102, body + "tail"), (103, body), (None, body), (104, "y" * 40_000)]
    full = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    rows = media.round_trip(full).collect()
    assert len(rows) == full.count()
    by = {r.doc_id: r for r in rows}
    for d in full.collect():
        raw = (d.text or "").encode()
        want = media.padded(raw)
        r = by[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    path = common.new_path(spark, "media")
    media.write(full, path)
    kept = {}
    for row in spark.read.parquet(path).collect():  # the form is what is stored, byte by byte
        form = bytes(row.head) + bytes(row.inline) + b"".join(bytes(c["data"]) for c in row.owned)
        kept[row.key.hex()] = (len(form), hashlib.sha256(form).hexdigest())
    assert {(r.media_bytes, r.media_sha256) for r in rows} == set(kept.values()) and all((r.media_bytes, r.media_sha256) == kept[r.payload_sha256] for r in rows)
    assert len({r.payload_sha256 for r in rows}) == len(kept)
    assert len(want) % 64 == 0 and media.padded(b"") == bytes(64) and media.padded(b"a" * 64) == b"a" * 64
    assert media.round_trip(full.limit(0)).count() == 0


def test_a_chunk_that_most_payloads_share(spark, monkeypatch):
    rng = random.Random(5)
    head = "".join(rng.choice("abcdefgh ") for _ in range(3 * media.MOST))
    rows = [(i % 190, f"{head} {i % 180}") for i in range(200)] + [(None, head), (None, head), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"SMALL": 0, "HOT": 20}):
        for name, value in settings.items():
            monkeypatch.setattr(media, name, value)
        if settings:
            monkeypatch.setattr(media, "meet", partial(common.meet, small=0, hot=20))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.payload_sha256) for r in media.round_trip(docs).collect())
        want = sorted((i is None, i or 0, hashlib.sha256(media.padded(t.encode())).hexdigest()) for i, t in rows)
        assert got == want
    path = common.new_path(spark, "media")
    media.write(docs, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 182
    assert sum(len(c["data"]) for r in stored.collect() for c in r.owned) < 2 * len(head)


def plain_winnow(text, k, w):
    if not text:
        return []
    codes = [ord(c) for c in text]
    import numpy as np

    h = winnowing.gram_hashes(np.array(codes, dtype="<u4"), min(k, len(codes))).tolist()
    w = min(w, len(h))
    chosen = set()
    for i in range(len(h) - w + 1):
        least = min(h[i : i + w])
        chosen.add(max(j for j in range(i, i + w) if h[j] == least))
    return [(h[j], j) for j in sorted(chosen)]


def test_winnowing_equals_plain():
    rng = random.Random(3)
    for n in (0, 1, 5, 15, 16, 17, 60, 79, 80, 200, 500):
        text = "".join(rng.choice("abé日 ") for _ in range(n))
        for k, w in ((16, 64), (3, 5), (2, 1), (4, 7)):
            got = winnowing.fingerprint(text, k, w)
            assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_winnow(text, k, w)
    a, b = "".join(rng.choice("abcdef") for _ in range(300)), "".join(rng.choice("abcdef") for _ in range(300))
    shared = "".join(rng.choice("abcdef") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    assert set(winnowing.fingerprint(a + shared + b)[0]) & set(winnowing.fingerprint(b + shared + a)[0])


def test_edited(docs, spark):
    rows = {r.doc_id: r for r in winnowing.edited_likeness(docs).collect()}
    ordered = docs.orderBy("doc_id").collect()
    texts = [d.text or "" for d in ordered]
    for i, d in enumerate(ordered):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        r = rows[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == winnowing.as_string(*winnowing.fingerprint(t))
        assert r.edited_fingerprint == winnowing.as_string(*winnowing.fingerprint(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(rows) == len(texts)
    alone = winnowing.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert winnowing.edited_likeness(docs.limit(0)).count() == 0
    assert winnowing.fingerprints(docs).count() == len(texts)


def test_short_texts_keep_several_hashes():
    """The likeness of a short text to its edited one follows the edit."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    import numpy as np

    found = []
    for n in [*range(30, 80)] * 4:
        text, cut = word(n), n // 4
        own, other = (np.unique(winnowing.fingerprint(t)[0]) for t in (text, text[: n - cut] + word(cut)))
        found.append(winnowing.likeness(own, other))
    assert min(found) > 0 and len(set(found)) > 5
