import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from postcast.llm import simhash as S
from postcast.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_parts(values, near):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_bit_sliced_kernels():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 64, 333, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.integers(0, 64, rng.integers(0, 9)):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    distance = np.bitwise_count(a ^ b)
    for radius in range(8):
        assert (S.close_pairs(a, b, radius) == (distance <= radius)).all()
    q, m = S.links_between(a, b, 4)
    assert set(zip(q.tolist(), m.tolist())) == set(map(tuple, np.argwhere(
        np.bitwise_count(a[:, None] ^ b[None, :]) <= 4).tolist()))


def test_fingerprint_equals_brute_force(hard):
    for _, t in hard:
        assert S.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("run", [2048, 3])
def test_links_connect_what_all_pairs_connect(spark, run, monkeypatch):
    """Dense clusters; with run=3 the keys are cut into blocks."""
    monkeypatch.setattr(S, "SMALL", 8)
    rng = random.Random(run)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    want = brute_parts(values, lambda x, y: (x ^ y).bit_count() <= 4)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp long"), Scratch(spark, "test"), run=run).collect()
    index = {s[0]: i for i, s in enumerate(signed)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in links:
        assert want[index[r.a]] == want[index[r.b]]
        parent[root(index[r.a])] = root(index[r.b])
    assert len({root(i) for i in range(len(values))}) == len(set(want))


def test_groups_of_documents(spark, make_docs, words, hard):
    rng = random.Random(8)
    pairs = [(i + 100, words(rng, 120)) for i in range(30)]
    for i in range(30):
        t = pairs[i][1].split(" ")
        t[rng.randrange(len(t))] = "edited"
        pairs.append((200 + i, " ".join(t)))
    pairs += [(300 + i, pairs[0][1]) for i in range(40)] + hard
    fps = [brute_fp(t) for _, t in pairs]
    parts = brute_parts(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for (i, _), p in zip(pairs, parts):
        key = (i is not None, i or 0)
        least[p] = min(least.get(p, key), key)
    want = Counter((i, f, least[p][1] if least[p][0] else None) for (i, _), f, p in zip(pairs, fps, parts))
    got = S.near_duplicates(make_docs(pairs)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r["first"].doc_id) for r in got) == want
    stay = S.keep_first(make_docs(pairs)).collect()
    assert len(stay) == len(set(parts))
    groups = {(i, t): p for (i, t), p in zip(pairs, parts)}
    assert len({groups[r.doc_id, r.text] for r in stay}) == len(stay)


def test_empty_table_and_columns(spark, make_docs):
    assert S.near_duplicates(make_docs([])).collect() == []
    assert S.keep_first(make_docs([])).collect() == []
    docs = make_docs([(1, "a b c d"), (2, "a b c d")]).withColumnRenamed("lang", "fp").withColumnRenamed("source", "first")
    out = S.keep_first(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_no_links_no_components(spark):
    from postcast.llm.common import connected_components
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none, Scratch(spark, "test")).collect() == []
