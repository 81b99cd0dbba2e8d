"""Token counts of greedy longest-match word pieces, without building pieces.

The vocabulary is a trie: pieces that begin a word hang below its root, pieces
that continue one below a second root.  Every node has a failure link and the
number of pieces that are popped on the way: where the text leaves the trie, the
longest piece that ended on the path, and those that greedily cover what follows
it, are counted at once, and matching goes on from the link without reading a
character twice.  A word takes linear time, whatever its pieces.

Words are runs of word characters and single other characters; white space
separates them.  A word that the vocabulary cannot cover, or one that is longer
than ``longest`` characters, counts as one unknown token; ``count_tokens`` has no
such bound.  In a vocabulary that
marks the begin of words, a word is matched with the mark before it: where no
longer piece begins so, the bare mark is a piece of its own (no piece, if the
vocabulary lacks it) and any piece may follow.

Defined cases: a null, empty or blank text has no tokens; repeated rows are
counted alike; extra columns stay out of the result unless named as keys; an
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postcast.llm.common import bounded_batches
from postcast.llm.memo import Memo

SLICE = 256
MAX_WORDS = 300_000  # most entries of the worker's memo table
LONGEST = 100  # characters of a word in the memo table
_WORDS = re.compile(r"\w+|[^\w\s]")


class PieceCounter:
    """Counts the pieces of a word.  ``pieces``: those that begin a word as they
    are, those that continue one with the prefix ``mark``.  ``begin``: a mark that
    stands before every word, as in ``marked_pieces``."""

    def __init__(self, pieces: list[str], mark: str = "##", longest: int | None = LONGEST, begin: str = ""):
        self.longest = longest
        self.begin = begin
        self.next: list[dict[str, int]] = [{}, {}]  # roots: begin 0, continue 1
        ends = {}
        for p in pieces:
            inner = p.startswith(mark) and len(p) > len(mark)
            node = 1 if inner else 0
            for c in p[len(mark):] if inner else p:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
            if node > 1:
                ends[node] = True
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [(child, 0, c) for c, child in self.next[0].items()]
        level += [(child, 1, c) for c, child in self.next[1].items()]
        while level:  # breadth first: links point to nodes that are done
            below = []
            for node, parent, c in level:
                if node in ends:
                    self.link[node], self.popped[node] = 1, 1
                else:
                    at, count = self.link[parent], self.popped[parent]
                    if parent == 0 and c == begin:  # a mark that is no piece counts nothing
                        self.link[node] = 1
                    while at >= 0 and c not in self.next[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.next[at][c], count
                below += [(child, node, d) for d, child in self.next[node].items()]
            level = below
        self.words = Memo(self.word, MAX_WORDS, LONGEST)

    def word(self, word: str) -> int:
        """Number of pieces of one word; 1 if it can't be covered."""
        if self.longest is not None and len(word) > self.longest:
            return 1
        next_, link, popped = self.next, self.link, self.popped
        node, count = 0, 0
        for c in self.begin + word:
            while c not in next_[node]:
                if link[node] < 0:
                    return 1
                count += popped[node]
                node = link[node]
            node = next_[node][c]
        while node != 1:
            if link[node] < 0:
                return 1
            count += popped[node]
            node = link[node]
        return count

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, _WORDS.findall(text)))


def pieces_of_words(vocabulary: list[str], begin: str = "▁", mark: str = "##") -> list[str]:
    """Word pieces from a vocabulary that marks the begin of words: marked pieces
    begin a word, the others continue one."""
    out = []
    for p in vocabulary:
        if p.startswith(begin):
            out.append(p[len(begin):])
        else:
            out.append(mark + p)
    return [p for p in out if p and p != mark]


def marked_pieces(vocabulary: list[str], begin: str = "▁", mark: str = "##") -> list[str]:
    """Word pieces for a counter that puts ``begin`` before every word: marked
    pieces keep their mark, the others, and the bare mark, may stand anywhere else."""
    marked = [p for p in vocabulary if p.startswith(begin)]
    return marked + [mark + p for p in vocabulary if p and (p == begin or not p.startswith(begin))]


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, pieces: list[str], keys: list[str] = ["doc_id"], text: str = "text",
                 mark: str = "##", begin: str = "") -> DataFrame:
    """Key columns and ``n_tokens`` of every whole text.  The vocabulary, some
    hundred kilobytes, is broadcast; each worker builds its trie once."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256("\0".join([mark, begin, *pieces]).encode()).hexdigest()
    src = docs.select(*keys, docs[text].alias("_text_"))
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType())])

    def run(batches):
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = PieceCounter(shared.value, mark, None, begin)
        counter = _COUNTERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = [counter.count(t) if t else 0 for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keys))]
                                                 + [pa.array(n, pa.int64())], names=schema.names)
    return src.mapInArrow(run, schema)
