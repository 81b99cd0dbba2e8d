import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcast.llm import sketches as K


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_estimates(words):
    rng = random.Random(3)
    for n in (3, 40, 100, 900):
        base = words(rng, n).split(" ")
        other = base[:n // 2] + words(rng, n).split(" ")
        a, b = " ".join(base), " ".join(other)
        x, y, X, Y = K.sketch(a), K.sketch(b), shingles(a), shingles(b)
        slack = 0 if len(X | Y) <= K.K else 0.2
        assert abs(K.resemblance(x, y) - jaccard(X, Y)) <= slack + 1e-9
        assert abs(K.containment(x, y) - len(X & Y) / len(X)) <= slack * 2 + 1e-9
        assert abs(K.distinct_count(x) - len(X)) <= 0.4 * len(X) * (len(X) >= K.K)
        both = K.merge(x, y)
        whole = K.sketch(a, 10 ** 6)
        assert (both == np.union1d(whole, K.sketch(b, 10 ** 6))[:K.K]).all()


def brute(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 2
        yield i, t, t[:len(t) - cut] + nxt[:cut], nxt


def check(docs, pairs):
    got = K.compare_with_next(docs).collect()
    want = list(brute(pairs))
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), bytes(r.sketch)) for r in got) \
        == Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest(), K.sketch(t).tobytes()) for i, t, e, _ in want)
    if len({i for i, _ in pairs}) == len(pairs):
        by = {r.doc_id: r for r in got}
        for i, t, e, nxt in want:
            small = len(shingles(t) | shingles(e)) <= K.K and len(shingles(t) | shingles(nxt)) <= K.K
            assert abs(by[i].near_edited - jaccard(shingles(t), shingles(e))) < (1e-9 if small else 0.25)
            assert abs(by[i].near_next - jaccard(shingles(t), shingles(nxt))) < (1e-9 if small else 0.25)


def test_next_documents(make_docs, words):
    rng = random.Random(6)
    ids = rng.sample(range(-50, 10 ** 6), 150)
    pairs = [(i, words(rng, rng.randint(0, 40))) for i in ids]
    pairs[5] = (pairs[5][0], pairs[6][1])
    check(make_docs(pairs).repartition(7), pairs)


def test_hard_rows(make_docs, hard):
    check(make_docs(hard), hard)


@pytest.mark.parametrize("pairs", [[(7, "only one document here")], [(2, "b b"), (1, "a a a")], [(1, None), (1, None)]])
def test_few_rows(make_docs, pairs):
    check(make_docs(pairs), pairs)


def test_empty_table(make_docs):
    assert K.compare_with_next(make_docs([])).collect() == []


def test_merged_over_groups(spark, make_docs, words):
    rng = random.Random(2)
    pairs = [(i, words(rng, 80)) for i in range(30)]
    docs = make_docs(pairs).withColumn("g", F.col("doc_id") % 2)
    for r in K.merged(docs, ["g"]).collect():
        every = np.unique(np.concatenate([K.sketch(t, 10 ** 6) for i, t in pairs if i % 2 == r.g]))[:K.K]
        assert [h + (1 << 63) for h in r.sketch] == every.tolist()
