"""Byte-level BPE encoding by tree concatenation, and decoding.

Long text is cut into halves again and again, wherever the middle falls; the parts are encoded on their own, in
parallel, and joined again. At a join only a window is encoded anew. It grows until its outermost tokens are the tokens
that the two sides have there; then everything outside the window stands.

Why that is exact: a sequence of byte pairs merged by rank is the encoding of its text if and only if each two
neighbouring tokens are the encoding of their own text. Neighbours outside the window were so in their part, those
inside are so in the window, and the two share a token at either end. A window may only begin and end where the
pre-tokenizer acts alike with and without what lies beyond (`safe_cut`).
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, partitions
from .tokens import CHUNK, LATIN, NOT_PLAIN, PIECES, PieceCache

#: Characters of a part that is encoded whole, of a piece without white space that is, and of a block that is a row of its own.
LEAF, RUN_LEAF, BLOCK = 4_096, 256, 16_384
BLANKS = " \n\t"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def safe_cut(before: str, after: str) -> bool:
    """Whether the pre-tokenizer does the same on either side of a cut here as without the cut, by the two characters there.

    No token goes from other characters into white space. Inside a run of letters, or of digits, either half is one
    piece of the same kind; runs of other characters are left out for the apostrophes in them.
    """
    if after in BLANKS:
        return not before.isspace()
    return (before.isalpha() and after.isalpha()) or (before.isdecimal() and after.isdecimal())


class TreeEncoder(PieceCache):
    ROW = re.compile(f" [{LATIN}]{{1,64}}")

    def __init__(self, name: str):
        super().__init__(name)
        chars, vocab = byte_of_char(), self.library.get_vocab()
        special = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        strings = sorted((t.decode() for t in special.values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings)) or "(?!)")
        self.special_ids = {t.decode(): i for i, t in special.items()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = special[i] if i in special else bytes(chars[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """Long pieces without white space go down the tree, the others to the library at once."""
        short = iter(super().encode_new([p for p in pieces if len(p) <= RUN_LEAF]))
        return [next(short) if len(p) <= RUN_LEAF else self.halves(p, RUN_LEAF).tobytes() for p in pieces]

    def ends(self, ids: np.ndarray, pieces: list[str]) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1

    def pieces(self, text: str) -> list[str]:
        return (CHUNK if NOT_PLAIN.search(text) else PIECES).findall(text)

    def leaf(self, text: str) -> np.ndarray:
        """Cached pieces; a single long piece, which would come back here, is the library's."""
        pieces = self.pieces(text)
        if len(pieces) == 1 and len(text) <= RUN_LEAF:
            return np.frombuffer(self.one_by_one(pieces)[0], dtype="<u2")
        return np.frombuffer(self.join(pieces), dtype="<u2")

    def halves(self, text: str, leaf: int) -> np.ndarray:
        if len(text) <= leaf:
            return self.leaf(text)
        middle = len(text) // 2
        return self.concatenate(self.halves(text[:middle], leaf), self.halves(text[middle:], leaf))

    def encode(self, text: str) -> np.ndarray:
        """The tree between special tokens' strings, which the library takes out before anything else."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.halves(text[at : m.start()], LEAF), np.array([self.special_ids[m.group()]], dtype="<u2")]
            at = m.end()
        return np.concatenate([*out, self.halves(text[at:], LEAF)]) if out else self.halves(text, LEAF)

    def blocks(self, text: str, size: int) -> list[str]:
        """The text in blocks of so many characters; a special token's string is not cut but moves to the next block."""
        inside = {k: m.start() for m in self.special.finditer(text) for k in range(m.start() // size + 1, -(-m.end() // size))}
        cuts = [inside.get(k, k * size) for k in range(math.ceil(len(text) / size))] + [len(text)]
        return [text[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def concatenate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the two texts together, from the ids of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        grow = 2
        while True:
            p, q = self.reach(left, grow, -1), self.reach(right, grow, 1)
            text = (self.text_of(left[len(left) - p :]) + self.text_of(right[:q])).decode()
            if p == len(left) and q == len(right):
                window = self.window(text)
                return window
            window = self.window(text)
            if (p == len(left) or window[0] == left[-p]) and (q == len(right) or window[-1] == right[q - 1]):
                return np.concatenate([left[: len(left) - p], window, right[q:]])
            grow *= 2

    def window(self, text: str) -> np.ndarray:
        """A window is encoded without a tree: by the library, or its cached pieces where it has grown."""
        if len(text) <= 4 * RUN_LEAF:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2")
        pieces = CHUNK.findall(text)
        return np.concatenate([np.asarray(e.ids, dtype="<u2") for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)])

    def reach(self, ids: np.ndarray, least: int, way: int) -> int:
        """Tokens from the join on, at least so many, up to a safe cut or the far end."""
        n = min(least, len(ids))
        while n < len(ids):
            at = len(ids) - n if way < 0 else n
            near = self.text_of(ids[max(0, at - 8) : at]), self.text_of(ids[at : at + 8])
            try:
                before, after = near[0].decode("utf-8", "ignore")[-1:], near[1].decode("utf-8", "ignore")[:1]
                clean = near[1][:1] and near[1][0] & 0xC0 != 0x80  # not amid a character
                if clean and before and after and safe_cut(before, after):
                    return n
            except UnicodeDecodeError:
                pass
            n += 1
        return n

    def decode(self, ids: np.ndarray) -> str:
        return self.text_of(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tree_encoder(name: str) -> TreeEncoder:
    return TreeEncoder(name)


def result(b_ids, ids: list[np.ndarray], enc: TreeEncoder, digests: bool) -> pa.RecordBatch:
    counts = pa.array([len(x) for x in ids], pa.int64())
    if not digests:
        return pa.RecordBatch.from_arrays([b_ids, counts, pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([enc.decode(x) for x in ids])], names=["doc_id", "n_tokens", "ids", "decoded"])
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return pa.RecordBatch.from_arrays([b_ids, counts, pa.array([sha(x.astype("<u4")) for x in ids], pa.string()), pa.array([sha(enc.decode(x).encode()) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", digests: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text; with `digests` the SHA-256 of the last two.

    Texts of more than `block` characters become rows of that many characters, dealt to all executors and encoded there;
    the blocks of a text, and no others, meet again in one task and are joined there from the left.

    Null and empty texts have no ids and decode to the empty text. Each repeated row is encoded for itself. An empty
    table gives no rows; further columns are ignored; a doc_id may be null.
    """
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    docs = id_text(docs)

    def run(it):
        enc = tree_encoder(tokenizer)
        for b in it:
            yield result(b.column(0), [enc.encode(t) for t in b.column(1).to_pylist()], enc, digests)

    def cut(it):
        for b in it:
            uid, doc, part, text = [], [], [], []
            for u, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, piece in enumerate(tree_encoder(tokenizer).blocks(t, block)):
                    uid.append(u)
                    doc.append(d)
                    part.append(k)
                    text.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(text, pa.string())], names=["uid", "doc_id", "part", "text"])

    def parts(it):
        enc = tree_encoder(tokenizer)
        for b in it:
            ids = pa.array([enc.encode(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], names=["uid", "doc_id", "part", "ids"])

    def join(t: pa.Table) -> pa.Table:
        enc = tree_encoder(tokenizer)
        t = t.sort_by("part")
        done = [np.frombuffer(x, dtype="<u2") for x in t["ids"].to_pylist()]
        while len(done) > 1:  # neighbours first, so that each id is copied a logarithm of times
            done = [enc.concatenate(*done[i : i + 2]) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        return pa.Table.from_batches([result(t["doc_id"].slice(0, 1).combine_chunks(), done, enc, digests)])

    short = batches(docs.where(F.length("text") <= block)).mapInArrow(run, kind)
    long = docs.where(F.length("text") > block).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = long.mapInArrow(cut, "uid long, doc_id long, part int, text string").repartition(partitions(docs.sparkSession), "uid", "part")
    joined = rows.mapInArrow(parts, "uid long, doc_id long, part int, ids binary").groupBy("uid").applyInArrow(join, kind)
    return short.unionAll(joined)
