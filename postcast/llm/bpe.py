"""Byte-level BPE encoding and decoding from a rank file.

The encoder never replays merges.  Bytes are mapped to Latin-1 characters, so an
Aho-Corasick automaton over the vocabulary finds the longest token at every
position of a piece in one pass.  Encoding then walks from longest match to
longest match and steps back (a shorter prefix token, or undoing the last token)
where two neighbours could not both come out of the merges.  Whether two tokens
can stand side by side is decided by undoing merges at their seam and is
memoised.  Every end position is visited at most once, so a piece takes linear
time, and the ids equal those of replaying the merges.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids
decode to no bytes; repeated rows are encoded alike; extra columns stay out of
the result unless named as keys; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postcast.llm.common import bounded_batches
from postcast.llm.memo import Memo

# Most entries of the worker's memo tables.
MAX_CHUNKS = 500_000
MAX_PIECES = 300_000
MAX_PAIRS = 500_000
# Documents per output batch.
SLICE = 256


class Vocabulary:
    """Tokens by rank, with the two tokens that the last merge of each joins.
    Built once on the driver; a few megabytes, whatever the corpus."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.shorter = [self._prefix(t) for t in tokens]
        self.joined: dict[tuple[int, int], int] = {}
        self.made = [len(t) == 1 for t in tokens]
        for i, t in enumerate(tokens):
            a = self.shorter[i]
            while a is not None:  # longest prefix first
                b = self.rank.get(t[len(tokens[a]):])
                if b is not None and a < i and b < i and self.made[a] and self.made[b] and self.fits(a, b):
                    self.left[i], self.right[i], self.joined[a, b], self.made[i] = a, b, i, True
                    break
                a = self.shorter[a]

    def digest(self) -> str:
        return hashlib.sha256(b"\0".join(self.tokens)).hexdigest()

    def _prefix(self, t: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        for k in range(len(t) - 1, 0, -1):
            if (r := self.rank.get(t[:k])) is not None:
                return r
        return None

    def fits(self, a: int, b: int) -> bool:
        """True if merging keeps a and b apart.  The later of the two merges is
        undone again and again at the seam; a merge across the seam that comes
        before the one just undone would have been taken."""
        left, right, joined = self.left, self.right, self.joined
        bound = len(self.tokens) + 1
        while True:
            if joined.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, right[a]
                if a == bound:
                    bound, b = b + 1, left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, left[b]
                if b + 1 == bound:
                    bound, a = a, right[a]
                    if a == bound:
                        return True


def load_ranks(path: str) -> Vocabulary:
    """Reads a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return Vocabulary([ranks[i] for i in range(len(ranks))])


class Encoder:
    """Encodes with one vocabulary; lives in a Python worker."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        import ahocorasick
        import regex
        self.v = vocab
        self.split = regex.compile(pattern).findall
        self.uneven = re.compile(r" \s|\s |^ | $").search
        self.sizes = [len(t) for t in vocab.tokens]
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(vocab.tokens):
            if vocab.made[i]:
                self.auto.add_word(t.decode("latin-1"), i)
        self.auto.make_automaton()
        self.pairs = Memo(lambda key: vocab.fits(key >> 20, key & 0xFFFFF), MAX_PAIRS)
        self.pieces = Memo(lambda p: np.array(self.piece(p.encode()), "<i4").tobytes(), MAX_PIECES)
        self.chunks = Memo(lambda c: self.by_pieces(" " + c), MAX_CHUNKS)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.v.rank.get(data)
        if whole is not None:
            return [whole]
        n, sizes, shorter, beside = len(data), self.sizes, self.v.shorter, self.pairs
        longest: list[int] = [-1] * (n + 1)
        for end, i in self.auto.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[i]] = i  # later ends overwrite shorter matches
        shut: set[int] = set()
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + sizes[token]
            if end not in shut and (not out or beside[out[-1] << 20 | token]):
                out.append(token)
                at = end
                token = longest[at]
            elif shorter[token] is not None:
                token = shorter[token]
            else:  # nothing fits here: this position is no end of a token
                shut.add(at)
                token = out.pop()
                at -= sizes[token]
        return out

    def by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers.  A single space
        between two characters that are no white space always starts a piece, so
        such a text is the sum of its space-led chunks; others go by pieces."""
        if self.uneven(text):
            return self.by_pieces(text)
        first, *rest = text.split(" ")
        return self.by_pieces(first) + b"".join(map(self.chunks.__getitem__, rest))


_ENCODERS: dict = {}


def _encoder(key: str, shared, pattern: str) -> Encoder:
    """The worker's encoder, kept from task to task by its vocabulary's digest."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, pattern] = Encoder(shared.value, pattern)
    return _ENCODERS[key, pattern]


def list_array(packed: list[bytes]) -> pa.Array:
    """list<int32> from packed ids."""
    ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def share(df: DataFrame, vocab: Vocabulary):
    bounded_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(vocab)


def encode(docs: DataFrame, vocab: Vocabulary, pattern: str, keys: list[str] = ["doc_id"],
           text: str = "text", shared=None) -> DataFrame:
    """Key columns and ``ids`` (array<int>) of every whole text."""
    shared, key = shared or share(docs, vocab), vocab.digest()
    src = docs.select(*keys, docs[text].alias("_text_"))
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = _encoder(key, shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [enc.encode(t) if t else b"" for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keys))] + [list_array(ids)],
                                                 names=[*keys, "ids"])
    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "decoded", shared=None) -> DataFrame:
    """Adds the bytes of the ids as a binary column: one take from the token
    table per batch, whose data buffer is the concatenation of the texts."""
    shared = shared or share(encoded, vocab)
    names = [c for c in encoded.columns if c != out]
    src = encoded.select(*names)
    schema = T.StructType([*src.schema.fields, T.StructField(out, T.BinaryType())])
    where = names.index(ids)

    def run(batches):
        tokens = pa.array(shared.value.tokens, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(where)
                flat = tokens.take(lists.flatten())
                n_ids = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.frombuffer(flat.buffers()[1], "<i8")[flat.offset:flat.offset + len(flat) + 1] \
                    if len(flat) else np.zeros(1, "<i8")
                bounds = ends[np.concatenate([[0], np.cumsum(n_ids)])]
                data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
                made = pa.Array.from_buffers(pa.large_binary(), part.num_rows,
                                             [None, pa.py_buffer(bounds.astype("<i8").tobytes()), data])
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(pa.binary())], names=[*names, out])
    return src.mapInArrow(run, schema)
