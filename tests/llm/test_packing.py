import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postcast.llm import packing
from postcast.llm.packing import Capacity


@pytest.fixture(scope="module")
def definition():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_ids_equal_the_library(definition):
    lib, own = Tokenizer.from_str(definition), packing.WordTokenizer(definition)
    rng = random.Random(2)
    odd = ["Then,", "DON'T", "É.", "Ñoz!", "straße?", "x²", "Ⅷ.", "áb", "İx", "ΑΣ", "ΟΔΟΣ.", " ", "<|endoftext|>",
           "a<|startoftext|>b", "½.", "é.", "ß!!", "ÿ", "Ÿ", "\x1c", "\x85", " x", "æ", "Å", "'s", "''"]
    for _ in range(4000):
        n, k = rng.randint(0, 30), rng.random()
        if k < .4:
            t = " ".join(rng.choice(odd) for _ in range(n))
        elif k < .7:
            t = "".join(rng.choice("abcABCÉéñÑß .,'s!?12\n") for _ in range(n))
        else:
            t = "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0, 0xD7FF)]))
                        for _ in range(n))
        assert np.frombuffer(own.encode(t), "<i4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_with_marks_need_no_whole_encoding(definition):
    lib, own = Tokenizer.from_str(definition), packing.WordTokenizer(definition)
    asked, whole = [], own.by_whole
    own.by_whole = lambda t: (asked.append(t), whole(t))[1]
    marks = [chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]
    text = " ".join([f"Haeder{m}{n}" for m in marks for n in marks] + ["ñmentedo***", "don't", "it's$", "x'$", "<|endoftext|>"])
    assert np.frombuffer(own.encode(text), "<i4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert [t for t in asked if t[0].isalpha()] == ["don't", "it's$", "x'$"]


def test_a_waiting_worker_keeps_the_first_words(definition):
    own = packing.WordTokenizer(definition)
    text = "the tide and the kettle and the harbour"
    once = own.encode(text)
    own.forget(keep=2)
    assert list(own.chunks) == ["the", "tide"] and own.encode(text) == once


def check_plan(plan, counts, cap):
    """Every piece has one place, places are gapless, capacities hold."""
    bins = defaultdict(list)
    seen = Counter()
    order = sorted(range(len(plan.length)), key=lambda i: (plan.length[i], plan.rank[i]))
    for n, i in enumerate(order):
        length, rank = int(plan.length[i]), int(plan.rank[i])
        nxt = order[n + 1] if n + 1 < len(order) and plan.length[order[n + 1]] == length else None
        end = int(plan.rank[nxt]) if nxt is not None else counts[length]
        assert rank == seen[length]
        seen[length] = end
        for nth in range(end - rank):
            bins[int(plan.sequence[i]) + nth // int(plan.per[i])].append(
                (int(plan.offset[i]) + nth % int(plan.per[i]) * length, length))
    assert seen == Counter(counts) and len(bins) == plan.sequences
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(rows) <= cap.documents
        assert sum(x * x for _, x in rows) <= cap.attention


@pytest.mark.parametrize("cap", [Capacity(20, 20, 400), Capacity(20, 3, 400), Capacity(20, 20, 210),
                                 Capacity(20, 4, 402)])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_constraint(cap, score):
    rng = random.Random(5)
    for _ in range(60):
        counts = {x: rng.randint(1, 30) for x in rng.sample(range(1, 15), rng.randint(1, 8))}
        check_plan(packing.best_fit(counts, cap, score=score), counts, cap)


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20000))
    plan = packing.plan_of(counts, Capacity())
    assert plan.sequences <= 1.01 * sum(k * v for k, v in counts.items()) / 4096 + 1


def test_plan_size_does_not_follow_the_rows():
    counts = {x: 1 for x in range(1, 400)}
    few = packing.best_fit(counts, Capacity())
    many = packing.best_fit({x: 10 ** 9 for x in counts}, Capacity())
    assert len(many.length) < 20 * len(few.length)


def test_too_long_a_piece():
    with pytest.raises(ValueError):
        packing.best_fit({30: 1}, Capacity(20, 20, 400))


def test_hard_rows(spark, make_docs, hard, definition):
    lib = Tokenizer.from_str(definition)
    rows = packing.pieces(make_docs(hard), definition, most=64).withColumn("crc", F.crc32("ids"))
    got = packing.pack(rows, Capacity(64, 64, 4096), ["doc_id", "piece", "crc"]).collect()
    want = Counter()
    for d, t in hard:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k:k + 64]
            want[d, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64


def test_empty_table(spark, make_docs, definition):
    rows = packing.pieces(make_docs([]), definition)
    assert packing.pack(rows).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, 3, "x", 9), (2, 0, 4, "y", 9)],
                               "doc_id long, piece int, length long, sequence_id string, offset int")
    got = packing.pack(df, Capacity(8, 8, 64)).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.sequence_id for r in got} == {0}


@pytest.mark.parametrize("length", [None, 0, 9])
def test_impossible_lengths(spark, length):
    df = spark.createDataFrame([(1, 0, length)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError):
        packing.pack(df, Capacity(8, 8, 64))
