"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has residual capacities for tokens, documents and attention cost
(the sum of squared piece lengths).  Pieces go longest first; among the open
sequences in which every capacity still holds, the one with the best score over
the normalised residuals takes the piece: the least weighted norm of what is
left (``norm``), or the largest weighted dot product of demand and residual
(``dot``).

A piece's demand depends on its length alone, so the plan is made on counts by
length: equal sequences form one class and take equal pieces in bulk.  The plan
has some thousand rows, whatever the number of pieces; the driver sees counts by
(length, block) only, at most capacity x BLOCKS.  Every piece then finds its
place from its rank among the pieces of its length, and ranks are counted inside
(length, block) groups, so a length that a third of all pieces share is spread
over BLOCKS groups.

Defined cases: a null or empty text still has the end token, hence one piece of
length 1; repeated rows are packed one by one; extra columns travel along, and
input columns named like an output column are replaced; a length that is null,
under 1 or over the capacity is an error; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.common import Scratch, bounded_batches
from postcast.llm.memo import Memo

BLOCKS = 256
SLICE = 256
# Most entries of the worker's memo table.
MAX_CHUNKS = 700_000
# Entries that a waiting worker keeps: those met first, which are the frequent ones.
IDLE_CHUNKS = 150_000
# The apostrophe is none of them: it can begin a token of its own ('s).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Capacity(NamedTuple):
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096


# ---------------------------------------------------------------- tokens

class WordTokenizer:
    """Packed ids of a text by a tokenizer that drops white space, remembered by
    chunk between single spaces or line feeds.

    Normalising and splitting never look across a space or a line feed, so a
    text's ids are those of its chunks.  A chunk of plain Latin letters and
    closing marks is further cut into word and marks; the lower-cased word goes
    to the model directly, anything else through the whole tokenizer.  Words and
    marks are remembered in the same table as the chunks."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(definition)
        self.model = self.whole.model
        spec = json.loads(definition)
        kinds = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        # the short cut holds only for lower-casing byte-level tokenizers that keep runs of marks together
        self.plain = "Lowercase" in kinds and "ByteLevel" in kinds and "\\\\s+" in kinds \
            and json.dumps(r"[^\s\p{L}\p{N}]+")[1:-1] in kinds
        self.cut = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)").fullmatch
        codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in codes]
        self.shown = {b: c for b, c in zip(codes + rest, codes + [256 + i for i in range(len(rest))])}
        self.chunks = Memo(self._of_chunk, MAX_CHUNKS)

    def forget(self, keep: int = IDLE_CHUNKS) -> None:
        if len(self.chunks) > keep:
            kept = list(islice(self.chunks.items(), keep))
            self.chunks.clear()
            self.chunks.update(kept)

    def by_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _of_word(self, word: str) -> bytes:
        """A lower-cased word of Latin-1 letters."""
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array("i", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _of_chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii() and chunk.isalpha():  # the usual chunk without a pattern
            word, marks = chunk, ""
        else:
            m = self.cut(chunk) if len(chunk) <= self.chunks.longest else None
            if m is None:
                return self.by_whole(chunk)
            word, marks = m.groups()
        low = word.lower()
        if low == chunk:
            return self._of_word(chunk)
        return self.chunks[low] + (self.chunks[marks] if marks else b"")

    def encode(self, text: str) -> bytes:
        if not self.plain:
            return self.by_whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENIZERS: dict = {}


def _tokenizer(key: str, shared) -> WordTokenizer:
    """The worker's tokenizer, kept from task to task by its content's digest."""
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(shared.value)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, definition: str, end_id: int = 1, most: int = 4096, keys: list[str] = ["doc_id"],
           text: str = "text") -> DataFrame:
    """Token pieces of every whole text: key columns, ``piece`` (from 0),
    ``start`` (ids before it in its document), ``length`` and ``ids`` (packed
    little-endian 32-bit).  ``definition`` is the JSON of a tokenizer file; every
    document ends with ``end_id``; only documents over ``most`` tokens are cut."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key = hashlib.sha256(definition.encode()).hexdigest()
    src = docs.select(*keys, docs[text].alias("_text_"))
    schema = T.StructType([docs.schema[k] for k in keys] + [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<i4").tobytes()
    names = schema.names
    step = 4 * most

    def cut(tok, batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, number, starts, lengths, ids = [], [], [], [], []
                for row, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    packed = (tok.encode(t) if t else b"") + end
                    for k, b in enumerate(range(0, len(packed), step)):
                        one = packed[b:b + step]
                        rows.append(row)
                        number.append(k)
                        starts.append(b // 4)
                        lengths.append(len(one) // 4)
                        ids.append(one)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keys))]
                    + [pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                       pa.array(ids, pa.binary())], names=names)

    def run(batches):
        tok = _tokenizer(key, shared)
        try:
            yield from cut(tok, batches)
        finally:  # the worker waits for other tasks with a small memo table
            tok.forget()

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- plan

class Plan(NamedTuple):
    """Bulk placements, sorted by (length, first rank).  The pieces of ``length``
    with ranks from ``rank`` on fill ``per`` places each in consecutive sequences
    from ``sequence``, at ``offset`` and on."""
    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def best_fit(counts: dict[int, int], cap: Capacity, weights=(1.0, 0.001, 0.01), score: str = "norm") -> Plan:
    """Vector best-fit decreasing on counts by length."""
    limit = np.array(cap, float)
    w = np.array(weights, float)
    left = np.empty((1024, 3))  # residuals of each class of equal sequences
    first = np.empty(1024, np.int64)
    many = np.zeros(1024, np.int64)
    n = sequences = 0
    placed: list[tuple[int, int, int, int, int]] = []

    def add(residual, at, count):
        nonlocal n, left, first, many
        if count and residual[0] >= 1 and residual[1] >= 1 and residual[2] >= 1:
            if n == len(many):
                live = many[:n] > 0
                if live.sum() < n // 2:  # drop the classes that are used up
                    n = int(live.sum())
                    left[:n], first[:n], many[:n] = left[:len(live)][live], first[:len(live)][live], \
                        many[:len(live)][live]
                else:
                    left, first, many = (np.concatenate([x, np.zeros_like(x)]) for x in (left, first, many))
            left[n], first[n], many[n] = residual, at, count
            n += 1

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], float)
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {cap}")
        todo, rank = counts[length], 0
        while todo:
            room = left[:n]
            fit = np.flatnonzero((many[:n] > 0) & (room >= demand).all(axis=1))
            if len(fit):
                if score == "norm":
                    s = (w * ((room[fit] - demand) / limit) ** 2).sum(axis=1)
                    k = fit[np.argmin(s)]
                else:
                    s = (w * (demand / limit) * (room[fit] / limit)).sum(axis=1)
                    k = fit[np.argmax(s)]
                residual, at, count = left[k].copy(), int(first[k]), int(many[k])
                many[k] = 0
            else:
                residual, at = limit.copy(), sequences
                count = -(-todo // int((limit // demand).min()))
                sequences += count
            per = int((residual // demand).min())
            full = min(count, todo // per)
            offset = int(limit[0] - residual[0])
            if full:
                placed.append((length, rank, per, at, offset))
                add(residual - per * demand, at, full)
                rank += full * per
                todo -= full * per
            if full < count:
                if todo:  # one more sequence takes the rest
                    placed.append((length, rank, todo, at + full, offset))
                    add(residual - todo * demand, at + full, 1)
                    rank += todo
                    full += 1
                    todo = 0
                add(residual, at + full, count - full)
    cols = np.array(sorted(placed), np.int64).reshape(-1, 5)
    return Plan(*(cols[:, i] for i in range(5)), sequences)


def plan_of(counts: dict[int, int], cap: Capacity) -> Plan:
    """The best of the two scores: fewest sequences."""
    return min((best_fit(counts, cap, score=s) for s in ("norm", "dot")), key=lambda p: p.sequences)


# ---------------------------------------------------------------- placing

def pack(items: DataFrame, cap: Capacity = Capacity(), order: list[str] = ["doc_id", "piece"],
         length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a length of 1 to
    ``cap.tokens``.  ``order`` names columns that tell the rows apart."""
    items = items.drop("sequence_id", "offset")
    scratch = Scratch(items.sparkSession, "packing")
    block = F.pmod(F.xxhash64(*order), F.lit(BLOCKS)).cast("int")
    table = scratch.save(items.withColumns({"_block": block, "_len": F.col(length).cast("int")}), "pieces")
    by = table.groupBy("_len", "_block").count().toPandas()  # at most capacity x BLOCKS rows
    if by["_len"].isna().any() or (by["_len"] < 1).any() or (by["_len"] > cap.tokens).any():
        raise ValueError(f"every length has to be 1 to {cap.tokens}")
    base = np.zeros((cap.tokens + 1, BLOCKS), np.int64)
    base[by["_len"].to_numpy(), by["_block"].to_numpy()] = by["count"].to_numpy()
    totals = base.sum(axis=1)
    base = np.cumsum(base, axis=1) - base
    plan = plan_of({int(x): int(totals[x]) for x in np.flatnonzero(totals)}, cap)
    used = np.flatnonzero(totals)
    row_of = np.full(cap.tokens + 1, -1, np.int32)
    row_of[used] = np.arange(len(used))
    shared = items.sparkSession.sparkContext.broadcast((plan, row_of, base[used]))
    ranked = table.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_len", "_block").orderBy(*order)).cast("long") - 1)
    keep = [f for f in ranked.schema.fields if f.name not in ("_block", "_len", "_rank")]
    schema = T.StructType(keep + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        p, rows, starts = shared.value
        keys = (p.length << 44) | p.rank
        for b in batches:
            size = b.column("_len").to_numpy().astype(np.int64)
            rank = b.column("_rank").to_numpy() + starts[rows[size], b.column("_block").to_numpy()]
            at = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            nth = rank - p.rank[at]
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in keep]
                + [pa.array(p.sequence[at] + nth // p.per[at]), pa.array(p.offset[at] + nth % p.per[at] * size)],
                names=schema.names)
    return ranked.mapInArrow(run, schema)
