"""Hashes of the word shingles of one text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of A-Z lower-cased, space-joined words, repeats
    included, in chunks of unsigned 64-bit integers.  Fewer words than a shingle
    give one shingle, no words none.  Work and memory follow the text."""
    import xxhash
    tokens = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return
    body = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    stops = ends[k - 1:]
    starts = np.concatenate([[0], ends[:len(tokens) - k] + 1])
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), CHUNK):
        a, b = starts[at:at + CHUNK].tolist(), stops[at:at + CHUNK].tolist()
        yield np.fromiter((digest(body[x:y], seed) for x, y in zip(a, b)), "<u8", len(a))
