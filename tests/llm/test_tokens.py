import hashlib
import random
import zlib

import numpy as np
from sluice.llm import token_files, tokens, tree_bpe
from sluice.llm.tokens import tokenizer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def test_tree_equals_library():
    library, enc = tokenizer(BYTE), tree_bpe.tree_encoder(BYTE)
    rng = random.Random(5)
    alphabet = ["the", "ion", "é", "ß", "日本", "'", "'s", "ll", " ", "  ", "\n", "\t", "12", "9", "!", "--", "😀", "a", "Z", "don't", "'re"]
    for n in (3, 50, 400, 3000):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
            want = library.encode(text, add_special_tokens=False).ids
            assert enc.encode(text).tolist() == want
            assert enc.halves(text, 7).tolist() == want
            assert enc.decode(enc.encode(text)) == library.decode(want, skip_special_tokens=False)
    for text in ("x" * 5000, "ab" * 3000, "日本語" * 900, "=" * 4000, " " * 3000, "aé" * 2000 + "'ll" * 500, "1234567890" * 400, "na" * 300 + " " + "ti" * 900):
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want
        assert enc.halves(text, 64).tolist() == want


def test_tree_with_rare_white_space_and_special_tokens(spark):
    library, enc = tokenizer(BYTE), tree_bpe.tree_encoder(BYTE)
    rng = random.Random(9)
    alphabet = ["the", "ion", "é", "日本", "'ll", " ", "\r\n", "\r", "\xa0", "\u3000", "\u2028", "\x85", "\x1c", "\x0b", "\u200b", "<|endoftext|>", "<|endof", "text|>", "12", "!", "\n", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in [4, 40, 400, 3000] * 40]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want
        assert "".join(enc.blocks(text, 9)) == text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tree_bpe.encode(docs, BYTE, block=150).collect()}
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))


def test_word_table_equals_library(monkeypatch):
    library, enc = tokenizer(WORD), tokens.WordEncoder(WORD)
    assert enc.row_library is not enc.library
    rng = random.Random(6)
    alphabet = ["the", "ion", "É", "ß", "ſ", "İ", "Ž", "×", "日本", "'", "ll", " ", "  ", "\n", "\t", "12", "9", "!", "--", "😀", "a", "Z", "don't", "x\u0301", "\r", "<|", "µ", "²"]
    plain = [a for a in alphabet if not tokens.NOT_PLAIN.search(a)]
    texts = ["", " ", "\n\n", "w" * 24, "w" * 25, "w" * 5000, "é" * 12, "é" * 13, "abcdefgh" * 3, "12345678" * 4, "a" * 8 + " " + "a" * 9]
    for _ in range(300):
        texts.append("".join(rng.choice(rng.choice([plain, plain, alphabet])) for _ in range(rng.randint(0, 80))))
    monkeypatch.setattr(enc, "BLOCK", 500)
    monkeypatch.setattr(enc, "MOST_IDS", 3000)
    enc.table = tokens.WordTable(16, 16)
    for _ in range(2):
        for text, ids in zip(texts, enc.encode_all(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens.WordTable, "hashes", lambda self, words: np.zeros(words.shape[1], dtype=np.uint64))
    enc = tokens.WordEncoder(WORD)
    for text, ids in zip(texts[:60], enc.encode_all(texts[:60]), strict=True):  # all words collide
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_documents(docs):
    library = tokenizer(BYTE)
    rows = {(r.doc_id): r for r in tree_bpe.encode(docs, BYTE, digests=True, block=100).collect()}
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert tree_bpe.encode(docs.limit(0)).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, 300)
    lengths = token_files.code_lengths(counts, 16)
    used = lengths > 0
    assert (used == (counts > 0)).all() and (0.5 ** lengths[used]).sum() == 1
    import heapq

    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert (lengths * counts).sum() == total
    skewed = token_files.code_lengths(2 ** np.arange(40), 16)
    assert skewed.max() == 16 and (0.5**skewed).sum() <= 1


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 5000) % 900).astype("<u2")
    lengths = token_files.code_lengths(np.bincount(ids, minlength=1 << 16))
    codes = token_files.canonical(lengths)
    bits, checks = token_files.pack_bits(ids, codes, lengths)
    n = np.full(len(checks), token_files.STRIDE)
    n[-1] = len(ids) - (len(checks) - 1) * token_files.STRIDE
    assert (token_files.unpack_bits(bits, checks, n, token_files.decode_table(lengths, codes)) == ids).all()


def test_token_files(docs, spark):
    library = tokenizer(WORD)
    at = 0
    rows = token_files.round_trip(docs).orderBy("doc_id").collect()
    for d, r in zip(docs.orderBy("doc_id").collect(), rows, strict=True):
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert token_files.round_trip(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, None), (3, "x"), (3, "x")], "doc_id long, text string")
    assert sorted(r.start for r in token_files.round_trip(twice).collect()) == [0, 1, 4, 6]
