"""The pipeline's stages, one by one against brute force, and hard rows."""
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_simhash import brute_fp, brute_parts
from test_substring_dedup import brute as brute_spans
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as C
from postcast.llm.line_dedup import MIN_CHARS

NAMES = ["quality rules", "line dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]


def corpus(words):
    rng = random.Random(21)
    text = lambda n: " ".join(words(rng, rng.randint(6, 14)) + " the of." for _ in range(n))
    notice = "All rights reserved by the owners of this page and of its parts."
    shared = text(7)
    rows = []
    for i in range(40):
        parts = [text(rng.randint(2, 4)) for _ in range(3)]
        if i % 4 == 0:
            parts.append(notice)
        if i % 5 == 0:
            parts[1] = parts[1] + " " + shared
        rows.append((i, "\n".join(parts)))
    for i in range(6):  # near copies in one line each, so that line dedup leaves them
        t = rows[i][1].replace("\n", " ").split(" ")
        rows.append((50 + i, " ".join(t)))
        t[3] = "changed"
        rows.append((60 + i, " ".join(t)))
    rows += [(70, "buy now " * 30), (71, "&&& $$$ ### ||| the of and <<< >>> *** %%% the"), (72, None), (73, "")]
    return rows


def test_stages_equal_brute_force(spark, make_docs, words):
    rows = corpus(words)
    docs = make_docs(rows)
    assert [n for n, _ in C.STAGES] == NAMES
    stages = dict(C.STAGES)

    good = stages[NAMES[0]](spark, docs, "")
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and set(kept) == {i for i, _ in rows if i < 70}
    assert all(kept[i] == t for i, t in rows if i < 70)

    lines = stages[NAMES[1]](spark, good, "")
    got = {r.doc_id: r.text for r in lines.collect()}
    gone = brute_lines(list(kept.items()), MIN_CHARS)
    want = {}
    for i, t in kept.items():
        ls = t.split("\n")
        want[i] = "\n".join(x for n, x in enumerate(ls) if n not in gone[i])
    assert got == want and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages[NAMES[2]](spark, lines, "")
    left = {r.doc_id: r.text for r in near.collect()}
    order = sorted(got)
    parts = brute_parts([brute_fp(got[i]) for i in order], lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for i, p in zip(order, parts):
        least.setdefault(p, i)
    assert left == {i: got[i] for i in least.values()} and near.columns == docs.columns
    assert len(left) < len(got)

    spans = stages[NAMES[3]](spark, near, "")
    rest = {r.doc_id: r.text for r in spans.collect()}
    assert rest == {i: t for i, (t, _) in brute_spans(list(left.items())).items()}
    assert spans.columns == docs.columns and rest != left

    packed = stages[NAMES[4]](spark, spans, "").collect()
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in packed:
        ids = lib.encode(rest[r.doc_id], add_special_tokens=False).ids + [1]
        assert np.frombuffer(r.ids, "<i4").tolist() == ids[r.start:r.start + r.length]
    assert {(r.doc_id, r.piece) for r in packed} == {(i, 0) for i in rest}
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert sum(n for _, n in b) <= 4096 and [o for o, _ in sorted(b)][0] == 0


def test_stages_keep_hard_rows_and_clashing_columns(spark, make_docs, hard):
    docs = make_docs(hard).withColumns({c: F.lit("theirs") for c in (
        "kept", "deleted", "n_lines", "removed", "fp", "first", "k", "units", "sequence_id", "offset", "piece")})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.kept == r.deleted == r.removed == r.fp == r.units == "theirs" for r in rows), name
        if "dedup" in name and "SimHash" not in name:
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in hard)
    assert C.STAGES[-1][1](spark, docs, "").count() > 0


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_run_over_driver_tables(spark):
    got = E.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
