"""Token ids of words and texts exactly as the tokenizers library gives them, with repeated words encoded once.

Both encoders cut a text only where the library's own pre-tokenizer must cut too, keep the ids of each piece in a
bounded cache, and give every piece that is not there to the library, many to a call. Ids fit unsigned 16 bits
(vocabularies below 65,536).

In a plain text (letters of the Latin blocks, other ASCII characters but the apostrophe) the pre-tokenizers cut between
letters and anything else. Other texts are cut at blanks only.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

CACHE_WORDS, CACHE_CHARS = 300_000, 8_000_000


def vocabulary(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers of the machine that runs this."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


#: Letters whose lower case is one letter and which no normal form changes.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ž"
NOT_PLAIN = re.compile(f"[^{LATIN} -&(-~\n]|<\\|")
WORDS = re.compile(f"[{LATIN}]+|[^{LATIN} \n]+")
PIECES = re.compile(f"[ \n]*(?:[{LATIN}]+|[^{LATIN} \n]+)|[ \n]+")
#: White space as pre-tokenizers know it: Unicode's White_Space.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class PieceCache:
    """piece -> ids as bytes, in two generations; a new one begins after CACHE_WORDS entries or CACHE_CHARS characters."""

    #: Pieces that can stand in one text, and what goes between them.
    ROW, BETWEEN = re.compile("(?!)"), ""

    def __init__(self, name: str):
        self.library = tokenizer(name)
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids must fit 16 bits")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def ends(self, ids: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Where the ids of each of the pieces end, in the ids of all in a row."""
        raise NotImplementedError

    def in_rows(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.asarray(self.library.encode_batch_fast([self.BETWEEN.join(part)], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = (2 * self.ends(ids, part)).tolist()
            if len(ends) != len(part) or ends[-1] != 2 * len(ids):
                raise AssertionError("pieces in a row were not cut as they stand")
            data, start = ids.tobytes(), 0
            for end in ends:
                out.append(data[start:end])
                start = end
        return out

    def one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u2").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        fits = [self.ROW.fullmatch(p) is not None for p in pieces]
        some, others = iter(self.in_rows([p for p, ok in zip(pieces, fits, strict=True) if ok])), iter(self.one_by_one([p for p, ok in zip(pieces, fits, strict=True) if not ok]))
        return [next(some if ok else others) for ok in fits]

    def join(self, pieces: list[str]) -> bytes:
        """Ids of the pieces, one after another, as little-endian unsigned 16-bit integers."""
        self.learn([pieces])
        return b"".join(map(self.new.__getitem__, pieces))

    def learn(self, texts: list[list[str]]) -> None:
        """Takes what these texts' pieces need into the cache."""
        if len(self.new) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0
        new = self.new
        missing = set().union(*texts).difference(new)
        for p in missing & self.old.keys():
            new[p] = self.old[p]
        unseen = [p for p in missing if p not in new]
        self.chars += sum(map(len, missing))
        new.update(zip(unseen, self.encode_new(unseen), strict=True))


class WordTable:
    """Words of up to 24 bytes, as three numbers each, and their ids; looked up many at once by open addressing."""

    def __init__(self, ids: int = 1 << 20, entries: int = 1 << 17):
        self.keys = np.zeros((3, entries), dtype=np.uint64)
        self.start, self.count = np.zeros(entries, dtype=np.int64), np.zeros(entries, dtype=np.int64)
        self.pool, self.used, self.n = np.zeros(ids, dtype="<u2"), 0, 0
        self.slots = np.full(4 * entries, -1, dtype=np.int32)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        h = words[0] * np.uint64(0x9E3779B97F4A7C15) + words[1] * np.uint64(0xBF58476D1CE4E5B9) + words[2] * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def places(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each word (a column of words), or -1."""
        at = self.places(h)
        found = self.slots[at].astype(np.int64)
        unlike = np.flatnonzero((found >= 0) & (self.keys[:, found] != words).any(axis=0))
        while len(unlike):
            at[unlike] = (at[unlike] + 1) & (len(self.slots) - 1)
            entry = self.slots[at[unlike]].astype(np.int64)
            found[unlike] = entry
            unlike = unlike[(entry >= 0) & (self.keys[:, entry] != words[:, unlike]).any(axis=0)]
        return found

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries without a key, their ids one after another; returns their numbers."""
        n, m = len(counts), len(ids)
        while self.n + n > len(self.start):
            self.keys, self.start, self.count = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.keys, self.start, self.count))
        while self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        new = np.arange(self.n, self.n + n)
        self.pool[self.used : self.used + m] = ids
        self.start[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.n, self.used = self.n + n, self.used + m
        return new

    def name(self, entries: np.ndarray, words: np.ndarray) -> None:
        """Gives entries their keys, distinct ones that no entry has."""
        self.keys[:, entries] = words
        if 2 * self.n > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int32)
            entries = np.flatnonzero(self.keys[0, : self.n])
        at = self.places(self.hashes(self.keys[:, entries]))
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries in a row, and where those of each end."""
        counts = self.count[entries]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.start[entries] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], ends


#: Of a byte of plain text in lower case: 0 white space, 1 (part of) a letter, 2 anything else.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[[0, 10, 32]] = 0
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
#: The low 0 to 8 bytes of a number.
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class WordEncoder(PieceCache):
    """For vocabularies that drop white space, lower case, and mark the end of each word.

    Plain texts are encoded block by block: words are cut and looked up as numbers, and only words that the table does
    not have yet are ever strings. Other texts go piece by piece.
    """

    ROW, BETWEEN = re.compile(f"[{LATIN}]{{1,64}}"), " "
    BLOCK, MOST_IDS = 1 << 18, 1 << 22

    def __init__(self, name: str):
        super().__init__(name)
        vocabulary = self.library.get_vocab()
        self.end = np.zeros(1 << 16, dtype=bool)
        for token, i in vocabulary.items():
            self.end[i] = token.endswith("</w>")
        self.table, self.long = WordTable(), {}
        self.row_library = self.without_patterns(name, [t[:-4] for t in vocabulary if re.fullmatch("[a-z]{2,}</w>", t)])

    def without_patterns(self, name: str, sample: list[str]):
        """The same model cutting at blanks only, which is all that rows of lower-case words need; the library itself
        where that would not give the same ids for the vocabulary's own words and their joins."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        fast = Tokenizer.from_file(vocabulary(name))
        fast.normalizer = normalizers.Sequence([])
        fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        row = " ".join([*sample[:2000], *(a + b + "éßž" for a, b in zip(sample[:500], sample[500:1000]))])
        same = fast.encode(row, add_special_tokens=False).ids == self.library.encode(row, add_special_tokens=False).ids
        return fast if same else self.library

    def ends(self, ids: np.ndarray, pieces: list[str]) -> np.ndarray:
        return np.flatnonzero(self.end[ids]) + 1

    def pieces(self, text: str) -> list[str]:
        if NOT_PLAIN.search(text):
            return text.replace("\n", " ").split(" ")
        return WORDS.findall(text.lower())

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.join(self.pieces(text)), dtype="<u2")

    def new_entries(self, words: list[str]) -> np.ndarray:
        """Table entries with the ids of lower-case words."""
        rows = [i for i, w in enumerate(words) if w[0].isalpha()]
        others = [i for i, w in enumerate(words) if not w[0].isalpha()]
        found, counts = [], []
        for at in range(0, len(rows), 512):
            part = [words[i] for i in rows[at : at + 512]]
            ids = np.array(self.row_library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u2")
            ends = np.flatnonzero(self.end[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise AssertionError("words in a row were not cut as they stand")
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        for e in self.library.encode_batch_fast([words[i] for i in others], add_special_tokens=False):
            found.append(np.array(e.ids, dtype="<u2"))
            counts.append(np.array([len(e.ids)]))
        entries = np.empty(len(words), dtype=np.int64)
        entries[rows + others] = self.table.add(np.concatenate(found), np.concatenate(counts))
        return entries

    def plain_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts."""
        if self.table.used > self.MOST_IDS:
            self.table, self.long = WordTable(), {}
        raw = [t.lower().encode() for t in texts]
        data = b"\n".join([*raw, bytes(24)])
        kind = KIND[np.frombuffer(data, dtype=np.uint8)]
        bounds = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        kept = kind[bounds] > 0
        start, size = bounds[kept], np.diff(bounds, append=len(data))[kept]
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        words = np.zeros((3, len(start)), dtype=np.uint64)
        words[0] = eight[start] & LOW[np.minimum(size, 8)]
        for i in (1, 2):
            far = np.flatnonzero(size > 8 * i)
            words[i, far] = eight[start[far] + 8 * i] & LOW[np.minimum(size[far] - 8 * i, 8)]
        table, h = self.table, self.table.hashes(words)
        entry = table.find(words, h)
        for i in np.flatnonzero(size > 24).tolist():
            word = data[start[i] : start[i] + size[i]].decode()
            if word not in self.long:
                self.long[word] = int(self.new_entries([word])[0])
            entry[i] = self.long[word]
        missing = np.flatnonzero(entry < 0)
        while len(missing):  # once, unless different words have one hash
            _, first = np.unique(h[missing], return_index=True)
            first = missing[np.sort(first)]
            a, z = start[first].tolist(), (start[first] + size[first]).tolist()
            table.name(self.new_entries([data[i:j].decode() for i, j in zip(a, z, strict=True)]), words[:, first])
            entry[missing] = table.find(words[:, missing], h[missing])
            missing = missing[entry[missing] < 0]
        ids, ends = table.ids(entry)
        of_text = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))
        return np.split(ids, np.concatenate([[0], ends])[of_text[:-1]])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of the texts of a batch."""
        out: list = [None] * len(texts)
        held, size = [], 0

        def flush():
            for i, ids in zip(held, self.plain_block([texts[i] for i in held]), strict=True):
                out[i] = ids

        for i, text in enumerate(texts):
            if NOT_PLAIN.search(text):
                out[i] = self.encode(text)
                continue
            held.append(i)
            size += len(text)
            if size > self.BLOCK:
                flush()
                held, size = [], 0
        if held:
            flush()
        return out


@lru_cache(maxsize=4)
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)
