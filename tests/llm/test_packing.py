import random
import zlib

import numpy as np
from sluice.llm import packing
from sluice.llm.tokens import tokenizer


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_plain_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.best_fit_plan(counts, capacity)
        rooms = {}
        for n, c in counts.items():
            rows = plan[plan[:, 0] == n]
            rows = rows[np.argsort(rows[:, 1])]
            for rank in range(c):
                _, k0, per, first, used = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
                b = first + (rank - k0) // per
                rooms.setdefault(b, []).append((used + (rank - k0) % per * n, n))
        for parts in rooms.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in rooms.values()) == plain_best_fit(lengths, capacity)


def test_pieces(docs, spark):
    rows = packing.pack(docs, capacity=512).collect()
    library = tokenizer("word_bpe_49k.json")
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in docs.collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 512))
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[r.start : r.start + 512]) for r in parts]
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(docs.limit(0)).count() == 0
