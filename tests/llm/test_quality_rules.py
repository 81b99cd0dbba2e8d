import re
from collections import Counter

from pyspark.sql import functions as F

from postcast.llm.quality_rules import judge, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def check(docs, pairs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in judge(docs).collect())
    assert got == Counter((i, *brute(t)) for i, t in pairs)


def test_measures_equal_brute_force(make_docs, words):
    import random
    rng = random.Random(9)
    pairs = []
    for i in range(120):
        t = words(rng, rng.randint(0, 60))
        if i % 3 == 0:
            t = t + "\n" + t[:rng.randint(0, len(t))] + "\n" + t
        if i % 5 == 0:
            t = t.replace(" ", rng.choice(["\n", " | ", "  ", "\t", "\x0b"]), 7)
        pairs.append((i, t))
    check(make_docs(pairs), pairs)


def test_hard_rows(make_docs, hard):
    check(make_docs(hard), hard)


def test_rejects_junk_and_keeps_prose(make_docs):
    prose = "The boat left early in the morning, and nobody on the pier had seen it go. It was raining again."
    junk = {2: " ".join("&&& cheap $$$ pills *** now ###".split() * 3), 3: "buy " * 40, 4: "short text",
            5: "!! ".join(f"w{i}" for i in range(30))}
    got = {r.doc_id: r for r in judge(make_docs([(1, prose), *junk.items()])).collect()}
    assert got[1].kept and not any(got[i].kept for i in junk)
    assert "symbols" in got[2].failed and "repeated_words" in got[3].failed and "length" in got[4].failed
    assert [r.doc_id for r in keep_good(make_docs([(1, prose), *junk.items()])).collect()] == [1]


def test_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "one two three four five six seven eight nine ten the")])
    docs = docs.withColumn("kept", F.lit("theirs")).withColumn("n_words", F.lit(-1))
    assert keep_good(docs).columns == docs.columns
    row = keep_good(docs).first()
    assert row.kept == "theirs" and row.n_words == -1
    assert keep_good(make_docs([])).collect() == [] and judge(make_docs([])).collect() == []


def test_native_plan(make_docs):
    plan = judge(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
