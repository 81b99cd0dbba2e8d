"""Substring dedup by hashing units of text: lines, paragraphs, and windows for
passages that stand inside other text.

A line or paragraph (lines without a blank one between them) of at least
``BLOCK_WORDS`` words is a unit, normalised to its words in lower case with single
spaces, so a paragraph is found however it is broken into lines.

For passages inside other lines, the words of a text are also cut into pieces: in
every ``WINDOW`` words in a row, a piece begins at the word with the smallest
hash, the last one of equals.  A cut depends on the ``WINDOW - 1`` words on
either side alone, and no piece but the last has more than ``WINDOW`` words.  A
window is ``JOINED`` pieces in a row, so windows overlap and are too long to repeat
by chance; a text of fewer pieces is one window.

All units are hashed to 128 bits.  Digests are grouped over all documents; the
earliest occurrence by (doc_id, text hash, unit number) stays.  A line or paragraph
that occurs earlier is removed.  Windows that occur earlier and touch form a span,
and a span of at least ``MIN_WORDS`` words or ``MIN_CHARS`` characters is removed,
while a short sentence inside other text that documents share by chance is left
alone.  Of a repeated passage of n words, at least n + 3 - 4 * WINDOW lie in pieces
that are cut alike everywhere, which is ``MIN_WORDS`` for n = 50.  A text that
repeats an earlier one as a whole is removed whatever its length.  White space alone
separates words, so a passage inside one long word is no passage.  Removed spans keep
their offsets (code points) in the original text and the document in which their
first unit occurs first.

Counting is combined before the shuffle and comes first, so only units that
occur twice meet their earliest occurrence; a digest that a third of all units
share is only ever joined with its one row, in plain equi-joins that AQE splits.
The units of one document, not those of a digest, are gathered.

Defined cases: a null text stays null; empty and blank texts have no units;
repeated rows count as one document and stay alike; copies under other ids are
emptied as far as they repeat; extra columns travel along; an empty table gives
an empty result.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.common import Scratch, bounded_batches

BLOCK_WORDS = 10  # of a line or paragraph
MIN_WORDS = 25
MIN_CHARS = 250  # of words joined by single spaces; for texts of long words
WINDOW, JOINED = 7, 3
SLICE = 256
LINES, PARAGRAPHS = 1 << 29, 1 << 30  # numbers of these units begin here
_WORD = re.compile(r"\S+")
_LOW = (1 << 31) - 1


def piece_bounds(words: list[str]) -> list[int]:
    """Numbers of the words that begin a piece, and the number of words."""
    n = len(words)
    if n < WINDOW:
        return [0, n]
    # the hash, then the place from the end: no two keys are equal
    least = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, n) << 31 | (_LOW - np.arange(n))
    wide = 1
    while wide < WINDOW:  # minima of windows of 1, 2, 4, ... words
        step = min(wide, WINDOW - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    picked = _LOW - (least & _LOW)
    picked = picked[np.flatnonzero(np.diff(picked, prepend=0))]  # they never decrease
    return [0, *picked.tolist(), n]


def unit_bounds(words: list[str]) -> list[tuple[int, int]]:
    """First word and end of the units, in order."""
    if not words:
        return []
    at = piece_bounds(words)
    return list(zip(at, at[JOINED:])) or [(0, len(words))]


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of the units in the text, in order."""
    words = [m.span() for m in _WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in unit_bounds([text[c:d].lower() for c, d in words])]


def blocks(text: str) -> list[tuple[int, str]]:
    """Numbers and content of the lines and paragraphs that are units."""
    out: list[tuple[int, str]] = []
    lines = text.split("\n")
    paragraph: list[str] = []
    joined = n = 0
    for i, line in enumerate([*lines, ""]):
        words = line.split()
        if words:
            if len(words) >= BLOCK_WORDS:
                out.append((LINES + i, " ".join(words)))
            paragraph += words
            joined += 1
        elif joined:
            if joined > 1 and len(paragraph) >= BLOCK_WORDS:
                out.append((PARAGRAPHS + n, " ".join(paragraph)))
            paragraph, joined, n = [], 0, n + 1
    return out


def block_spans(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Begin and end of these lines and paragraphs, without the white space around."""
    out = {}
    at, n, begin, end = 0, 0, None, 0
    for i, line in enumerate([*text.split("\n"), ""]):
        solid = line.strip()
        if solid:
            left = at + line.index(solid)
            if LINES + i in wanted:
                out[LINES + i] = (left, left + len(solid))
            begin, end = left if begin is None else begin, left + len(solid)
        elif begin is not None:
            if PARAGRAPHS + n in wanted:
                out[PARAGRAPHS + n] = (begin, end)
            begin, n = None, n + 1
        at += len(line) + 1
    return out


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per unit: the document (d, h), unit number, 128-bit digest; the whole
    text has number -1."""
    src = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    schema = "d long, h long, u int, d1 long, d2 long"

    def run(batches):
        import xxhash
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes, digests, number = [], [], []
                for t in part.column(2).to_pylist():
                    words = t.lower().split() if t else []
                    spans = unit_bounds(words)
                    own = blocks(t.lower()) if spans else []
                    sizes.append(len(spans) + len(own) + 1 if spans else 0)
                    if spans:
                        digests.append(digest("\n" + " ".join(words)))  # equal to no unit
                        number.append(-1)
                    for a, b in spans:
                        digests.append(digest(" ".join(words[a:b])))
                    number += range(len(spans))
                    for u, body in own:
                        digests.append(digest("\r" + body))  # equal to no window
                        number.append(u)
                rows = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(number, pa.int32()),
                     pa.array(both[:, 0]), pa.array(both[:, 1])], names=["d", "h", "u", "d1", "d2"])
    return src.mapInArrow(run, schema)


def later_units(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """Per document (d, h): the units that occur earlier, with the document of the
    earliest occurrence, by unit number."""
    every = scratch.save(units(docs, text), "units")
    # Counts and minima are written, so that either side of a join is a plain exchange,
    # which AQE can split where a digest is very frequent.  Half a digest is enough to
    # leave out units that occur once; both halves decide.
    twice = scratch.save(every.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    seen = scratch.save(every.join(twice, "d1"), "repeated")
    first = scratch.save(seen.groupBy("d1", "d2").agg(F.min(F.struct("d", "h", "u")).alias("first")), "first")
    later = seen.join(first, ["d1", "d2"]).where(F.struct("d", "h", "u") > F.col("first"))
    flags = later.select("d", "h", F.struct("u", F.col("first.d").alias("source")).alias("unit")).distinct()
    out = scratch.save(flags.groupBy("d", "h").agg(F.sort_array(F.collect_list("unit")).alias("units")), "later")
    scratch.drop(every, twice, seen, first)
    return out


def cut(text: str | None, flagged: list[dict] | None, min_words: int):
    """The text without its repeated spans, and the spans (begin, end, source)."""
    if not flagged:
        return text, []
    spans = unit_spans(text)
    whole = flagged[0]["u"] < 0
    windows = [f for f in flagged[whole:] if f["u"] < LINES]
    found, run = [], []  # (begin, end, source)
    for f in [*windows, None]:
        if run and (f is None or f["u"] > run[-1]["u"] + JOINED):  # they neither overlap nor touch
            begin, end = spans[run[0]["u"]][0], spans[run[-1]["u"]][1]
            words = text[begin:end].split()
            if whole or len(words) >= min_words or len(" ".join(words)) >= MIN_CHARS:
                found.append((begin, end, run[0]["source"]))
            run = []
        run.append(f)
    sources = {f["u"]: f["source"] for f in flagged if f["u"] >= LINES}
    found += [(a, b, sources[u]) for u, (a, b) in block_spans(text, set(sources)).items()] if sources else []
    removed: list[tuple[int, int, int]] = []
    for begin, end, source in sorted(found, key=lambda s: (s[0], -s[1])):
        after = _WORD.search(text, end)
        end = after.start() if after else len(text)  # with the break behind it
        if removed and begin <= removed[-1][1]:
            removed[-1] = (removed[-1][0], max(end, removed[-1][1]), removed[-1][2])
        else:
            removed.append((begin, end, source))
    kept, at = [], 0
    for a, b, _ in removed:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), removed


def dedup_substrings(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns with ``text`` cut, and ``removed``: array of (begin, end,
    source) in the original text."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    flags = later_units(docs, scratch, text)
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h")).alias("_k"),
                        F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns
                                                               if c not in (text, "removed")]).alias("_rest"))
    joined = keyed.join(flags.select(F.struct("d", "h").alias("_k"), "units"), "_k", "left") \
        .select("_rest", "_text", "units")
    spans = T.ArrayType(T.StructType.fromDDL("begin int, end int, source long"))
    schema = T.StructType([joined.schema["_rest"], T.StructField("_text", T.StringType()),
                           T.StructField("removed", spans)])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [cut(t, f, min_words) for t, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in made], pa.string()),
                     pa.array([[dict(zip(("begin", "end", "source"), s)) for s in r] for _, r in made], kind)],
                    names=schema.names)
    done = joined.mapInArrow(run, schema)
    columns = [F.col(f"_rest.`{c}`") if c != text else F.col("_text").alias(text) for c in docs.columns
               if c != "removed"]
    return done.select(*columns, "removed")
