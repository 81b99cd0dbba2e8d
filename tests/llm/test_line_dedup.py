import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postcast.llm.line_dedup import dedup_lines


longest = {}


def brute(pairs, min_chars):
    """Lines of every repeated run of at least min_chars that occurs earlier; all
    windows are tried."""
    seqs = {}
    for i, t in sorted(set(pairs), key=lambda p: p[0]):
        seqs[i] = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    first, gone = {}, {i: set() for i in seqs}
    longest.clear()
    for i, s in seqs.items():
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(map(len, s[a:b])) >= min_chars:
                    if tuple(s[a:b]) in first:
                        gone[i].update(range(a, b))
                        if b - a in (1, 2, 4, 8, 16):
                            longest[i] = max(longest.get(i, 0), b - a)
                    else:
                        first[tuple(s[a:b])] = i
    return gone


@pytest.mark.parametrize("seed,min_chars", [(1, 3), (2, 5), (3, 1), (4, 12)])
def test_equals_all_windows(make_docs, seed, min_chars):
    rng = random.Random(seed)
    pairs = [(i, "\n".join(rng.choice(["a", "bb", "ccc", "d", "", " ", "eeeee", f"u{rng.randint(0, 40)}"])
                           for _ in range(rng.randint(0, 9)))) for i in range(40)]
    pairs.append((40, "\n".join(["x", "yy"] * 8)))
    want = brute(pairs, min_chars)
    got = dedup_lines(make_docs(pairs), min_chars=min_chars).collect()
    assert {r.doc_id: set(r.deleted) for r in got} == want
    if min_chars == 1:
        assert {r.doc_id: r.longest for r in got} == {i: longest.get(i, 0) for i in want}
    texts = dict(pairs)
    for r in got:
        solid = -1
        kept = []
        for line in texts[r.doc_id].split("\n"):
            solid += bool(line.strip())
            if not line.strip() or solid not in want[r.doc_id]:
                kept.append(line)
        if r.n_lines and len(r.deleted) == r.n_lines:
            assert r.text == ""
        else:
            assert r.text == "\n".join(kept)


def test_boilerplate_and_copies(make_docs):
    """Repeated lines of any length go; a bound leaves the short ones."""
    line = "This sentence stands below every article of the site."
    pairs = [(i, f"article number {i} has its own first line here\nok\n{line}") for i in range(1, 60)]
    pairs += [(100, pairs[0][1]), (101, "short\nshort"), (102, "}")]
    got = {r.doc_id: r for r in dedup_lines(make_docs(pairs)).collect()}
    assert got[1].deleted == [] and got[2].text == "article number 2 has its own first line here"
    assert got[100].text == "" and got[101].text == "short" and got[102].text == "}"
    assert [got[i].longest for i in (1, 2, 100, 101, 102)] == [0, 2, 2, 1, 0]
    got = {r.doc_id: r for r in dedup_lines(make_docs(pairs), min_chars=30).collect()}
    assert got[2].text == "article number 2 has its own first line here" and got[101].text == "short\nshort"


def test_many_lines(make_docs):
    """Two copies of a text of 100,000 lines, linear in the lines."""
    body = "\n".join(f"line {i} of a long text" for i in range(100_000))
    docs = make_docs([(1, body), (2, body), (3, "one\n" * 100_000)])
    start = time.time()
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert time.time() - start < 240  # work that is done anew for every line takes many times as long
    assert got[1].text == body and got[2].text == "" and got[2].longest == 65536
    assert got[3].n_lines == 100_000 and len(got[3].deleted) == 99_999


def test_hard_rows(make_docs, hard):
    got = dedup_lines(make_docs(hard)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in hard)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(hard)


def test_columns_and_empty_table(make_docs):
    assert dedup_lines(make_docs([])).collect() == []
    docs = make_docs([(1, "x" * 40), (2, "x" * 40)]).withColumns({"k": F.lit(1), "j": F.lit(2), "start": F.lit(3)})
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "deleted", "longest"]
    assert {r.doc_id: (r.text, r.k, r.j, r.start) for r in out.collect()} == {1: ("x" * 40, 1, 2, 3), 2: ("", 1, 2, 3)}


def test_native_plan(make_docs):
    plan = dedup_lines(make_docs([(1, "x" * 40), (2, "x" * 40)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
