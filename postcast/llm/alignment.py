"""Cross-tokenizer alignment: how the tokens of two vocabularies cover one text.

Texts are shuffled by their whole content, so each distinct text is encoded and
aligned once, and its number of documents is its weight.  Vocabulary A is
byte-level BPE over a space and the text, vocabulary B a SentencePiece model over
the text (it adds the space).  Both cover the same bytes; the byte offsets where a
token of A and one of B end together cut the tokens into groups, and a link is a
pair of occurrences whose byte ranges overlap.  The count of an id pair is the
number of documents that hold it linked: the weights of the distinct texts summed
by pair, combined before the shuffle.  A text's measures come from its distinct
pairs and their counts, and join the documents by the text's SHA-256.

Inside a task, a text is cut at single spaces between two characters that are no
white space.  Neither vocabulary has a token across such a place (checked when they
are loaded), so the alignment of a text is that of its parts, end to end.  Parts are
remembered; those of a batch that are new are encoded by one call of each library
and aligned together with array operations.  Texts with other white space around a
space, very long parts, and texts whose tokens don't give back their bytes are
encoded on their own.

The table of pair counts has at most |A| * |B| rows and in practice far fewer.  Its
rows are counted: up to ``BROADCAST_PAIRS`` (about 40 bytes each in an executor) it
is broadcast, beyond that both sides are shuffled by pair.  Results are the same.

Defined cases: null and empty texts, and texts whose joined token bytes of either
vocabulary differ from space and text (for example those with U+2581), have no
tokens: zeros and an empty ``groups_sha256``.  Every row is a document, repeated
rows too, and gets a row; a null key stays null.  Extra columns stay out of the
result; an empty table gives an empty result.  Special tokens' strings are plain
text.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postcast.llm.common import Scratch, bounded_batches

BROADCAST_PAIRS = 2_000_000
MAX_PARTS = 500_000  # parts that a worker remembers
LONG = 1_000  # characters of a part that is neither remembered nor encoded with others
SLICE = 128
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are written:
    printable Latin-1 characters stand for themselves, the other bytes in order
    for the characters from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def tokens_of_json(text: str) -> dict[str, int]:
    """Entry by id of a byte-level BPE file, special tokens left out."""
    spec = json.loads(text)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {t: i for t, i in spec["model"]["vocab"].items() if t not in special}


def aligned_pairs(ids_a, ends_a, ids_b, ends_b, width: int):
    """Alignment of two token sequences over the same bytes: per token of A its
    number of links, the linked pairs as a * width + b in order of A, and the index of
    the group of every token of A and of B."""
    starts_a, starts_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
    first = np.searchsorted(ends_b, starts_a, "right")
    links = np.searchsorted(starts_b, ends_a, "left") - first
    before = np.cumsum(links) - links
    b = np.repeat(first - before, links) + np.arange(links.sum())
    pairs = np.repeat(ids_a, links) * np.int64(width) + ids_b[b]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return links, pairs, np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left")


def distinct_pairs(pairs: list[np.ndarray], kind: np.dtype):
    """Distinct pairs of each text, their numbers of links, and where each text ends."""
    made = [np.unique(p, return_counts=True) for p in pairs]
    ends = np.cumsum([0, *(len(p) for p, _ in made)]).astype("<i4")
    return (np.concatenate([p for p, _ in made]).astype(kind),
            np.concatenate([n for _, n in made]).astype(np.int32), pa.array(ends))


class Aligner:
    """Both vocabularies; lives in a Python worker."""

    def __init__(self, byte_bpe: str, model: bytes, most: int = MAX_PARTS):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        spec, alphabet = json.loads(byte_bpe), byte_alphabet()
        entries = tokens_of_json(byte_bpe)
        raw = {i: bytes(alphabet[c] for c in t) for t, i in entries.items()}
        size = max(raw) + 1
        self.bytes_a = [raw.get(i, b"") for i in range(size)]
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        # the rank library encodes long texts faster; it needs merges in order of their ids
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [entries.get("".join(m)) for m in merges]
        self.fast = None
        if made == list(range(256, 256 + len(merges))) and not spec.get("normalizer") \
                and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                              "use_regex": True}:
            import public_tokenizers
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                          mergeable_ranks={raw[i]: i for i in raw})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i)
                        else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        # parts stand alone if no piece has a space behind another character
        self.by_parts = self.fast is not None and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.kind = np.dtype("<i4") if size * self.width < 1 << 31 else np.dtype("<i8")
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.all_a, self.all_b = (pa.array(t, pa.large_binary()) for t in (self.bytes_a, self.bytes_b))
        # decimal ids, each followed by what can stand behind it
        top = max(size, self.width)
        self.shown = pa.array([f"{i}{end}".encode() for end in ",|;" for i in range(top)], pa.large_binary())
        self.top = top
        self.most = most
        self._forget()

    @staticmethod
    def _joined(ids: np.ndarray, table: pa.Array) -> tuple[bytes, np.ndarray]:
        """The entries of the ids, end to end, and where each ends."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        flat = table.take(pa.array(ids))
        ends = np.frombuffer(flat.buffers()[1], "<i8")[1:len(ids) + 1]
        return flat.buffers()[2].to_pybytes()[:ends[-1]], ends

    def _align(self, ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray):
        """Alignment of texts that stand end to end and each end at ``ends`` (bytes):
        all pairs in order, and per text its groups as text, each with a separator
        behind it, and its numbers of tokens of A, of B, of groups and of links."""
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        links, pairs, group_a, group_b = aligned_pairs(ids_a, ends_a, ids_b, ends_b, self.width)
        # the tokens in order of group, those of A first
        where_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        where_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[where_a] = ids_a + np.r_[group_a[1:] != group_a[:-1], True] * self.top
        order[where_b] = ids_b + np.r_[group_b[1:] != group_b[:-1], True] * (2 * self.top)
        text, text_ends = self._joined(order, self.shown)
        at_a, at_b = np.searchsorted(ends_a, ends, "left") + 1, np.searchsorted(ends_b, ends, "left") + 1
        at = np.stack([at_a, at_b, group_a[at_a - 1] + 1, np.cumsum(links)[at_a - 1]], 1)
        cut = text_ends[at_a + at_b - 1].tolist()
        return pairs, [text[x:y] for x, y in zip([0, *cut], cut)], np.diff(at, axis=0, prepend=0)

    def direct(self, text: str):
        """Alignment of one text on its own; None where it has no tokens."""
        body = b" " + text.encode()
        if not text or self._joined(ids_b := np.array(self.b.encode(text), np.int64), self.all_b)[0] != body:
            return None
        ids_a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        if self._joined(ids_a, self.all_a)[0] != body:
            return None
        pairs, shown, numbers = self._align(ids_a, ids_b, np.array([len(body)]))
        return pairs, shown[0][:-1], numbers[0]

    def _forget(self) -> None:
        self.parts = _Numbers()
        self.shown_of: list[bytes] = []
        self.numbers = np.empty((0, 4), np.int64)
        self.pairs, self.filled = np.empty(0, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        """Remembers the parts, aligned in one go."""
        # a few kilobytes at a time, as the library's time grows faster than the text
        lines = [" ".join(new[n:n + 256]) for n in range(0, len(new), 256)]
        body = (" " + " ".join(lines)).encode()
        ids_a = np.array([i for x in lines for i in self.fast.encode_ordinary(" " + x)], np.int64)
        ids_b = np.array([i for x in self.b.encode(lines, num_threads=1) for i in x], np.int64)
        if self._joined(ids_a, self.all_a)[0] != body or self._joined(ids_b, self.all_b)[0] != body:
            return  # one of them has no tokens; their texts are encoded on their own
        pairs, shown, numbers = self._align(ids_a, ids_b, np.cumsum(np.array([len(p.encode()) + 1 for p in new])))
        self.parts.update(zip(new, range(len(self.shown_of), len(self.shown_of) + len(new))))
        self.shown_of += shown
        self.numbers = np.concatenate([self.numbers, numbers])
        if self.filled + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs[:self.filled], np.empty(self.filled + len(pairs), np.int64)])
        self.pairs[self.filled:self.filled + len(pairs)] = pairs
        self.filled += len(pairs)

    def _of_parts(self, numbers: list[int]):
        """A text's alignment from those of its parts."""
        at = np.array(numbers)
        links = self.numbers[at, 3]
        first = self.starts[at] - (np.cumsum(links) - links)
        return (self.pairs[np.repeat(first, links) + np.arange(links.sum())],
                b"".join(map(self.shown_of.__getitem__, numbers))[:-1], self.numbers[at].sum(0))

    def texts(self, texts: list[str]):
        """Per text: (pairs of all links, groups as text, numbers of A, B, groups and
        links), or None without tokens."""
        lost = [not t or _SPACE in t for t in texts]  # the piece of U+2581 gives back a space
        cut = [t.split(" ") if self.by_parts and not bad else [] for t, bad in zip(texts, lost)]
        some = set().union(*cut)
        new = some.difference(self.parts)
        if len(self.parts) + len(new) > self.most:
            self._forget()
            new = some
        # a part that is empty or begins or ends with white space does not stand alone
        new = [p for p in new if p and len(p) <= LONG and not p[0].isspace() and not p[-1].isspace()]
        if new:
            self._learn(new)
            self.starts = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
        for t, c, bad in zip(texts, cut, lost):
            numbers = list(map(self.parts.__getitem__, c))
            if bad:
                yield None
            elif not numbers or -1 in numbers:
                yield self.direct(t)
            else:
                yield self._of_parts(numbers)


class _Numbers(dict):
    """Numbers of the remembered parts; -1 for others."""

    def __missing__(self, key: str) -> int:
        return -1


_ALIGNERS: dict = {}


def _aligner(key: str, shared) -> Aligner:
    """The worker's aligner, kept from task to task by its vocabularies' digest."""
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*shared.value)
    return _ALIGNERS[key]


def align_texts(texts: DataFrame, byte_bpe: str, model: bytes) -> DataFrame:
    """Alignment of the texts of (key, n, text): numbers of tokens, groups and links,
    digest of the groups, distinct pairs (a * size of B + b) and their links.  Texts
    without tokens have no row."""
    spark = texts.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((byte_bpe, model))
    digest = hashlib.sha256(byte_bpe.encode() + model).hexdigest()
    size_a = max(tokens_of_json(byte_bpe).values()) + 1
    import sentencepiece
    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    kind = "int" if size_a * width < 1 << 31 else "long"
    schema = (f"key binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              f"pairs array<{kind}>, links array<int>")

    def run(batches):
        aligner = _aligner(digest, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, numbers, shas, pairs = [], [], [], []
                for row, found in enumerate(aligner.texts(part.column(2).to_pylist())):
                    if found is not None:
                        rows.append(row)
                        pairs.append(found[0])
                        shas.append(hashlib.sha256(found[1]).hexdigest())
                        numbers.append(found[2])
                if not rows:
                    continue
                numbers = np.array(numbers)
                pairs, links, ends = distinct_pairs(pairs, aligner.kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                     *(pa.array(numbers[:, k]) for k in range(4)), pa.array(shas, pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(links))],
                    names=["key", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
    return texts.select("key", "n", "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """Documents by pair, and whether no pair of the same id of A has more."""
    counts = aligned.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("documents"))
    # at most as many rows for an id of A as B has ids
    most = F.max("documents").over(Window.partitionBy((F.col("pair") / width).cast("long")))
    return counts.select("pair", "documents", (F.col("documents") == most).alias("best"))


def align(docs: DataFrame, byte_bpe: str, model: bytes, doc: str = "doc_id", text: str = "text",
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: its key, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    import sentencepiece
    scratch = Scratch(docs.sparkSession, "alignment")
    width = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    rows = docs.select(F.col(f"`{doc}`").alias("_doc"), F.col(f"`{text}`").alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    aligned = scratch.save(align_texts(distinct.withColumn("key", F.unhex(F.sha2("text", 256))), byte_bpe, model),
                           "aligned")
    counts = scratch.save(pair_counts(aligned, width), "pair_counts")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = aligned.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("p")) \
        .select("key", F.col("p.pairs").alias("pair"), F.col("p.links").cast("long").alias("links"))
    sums = each.join(counts, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("documents")).alias("count_sum"))
    measures = aligned.drop("pairs", "links", "n").join(sums, "key", "left")
    measures = scratch.save(measures, "measures")
    out = rows.select("_doc", F.unhex(F.sha2("text", 256)).alias("key")).join(measures, "key", "left")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select(F.col("_doc").alias(doc), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
