import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from postcast.llm.substring_dedup import (BLOCK_WORDS, LINES, MIN_WORDS, PARAGRAPHS, blocks, cut, dedup_substrings,
                                           unit_spans)


def key(i, t):
    return (i is not None, i or 0), t


def own_blocks(text):
    """(number, normalised content) of lines and paragraphs of 10 or more words."""
    lines = [" ".join(x.split()) for x in text.lower().split("\n")]
    out = [(LINES + n, x) for n, x in enumerate(lines)]
    groups = [list(g) for solid, g in itertools.groupby(lines, bool) if solid]
    out += [(PARAGRAPHS + n, " ".join(g)) for n, g in enumerate(groups) if len(g) > 1]
    return [(n, x) for n, x in out if len(x.split()) >= 10]


def brute(pairs):
    """Earliest occurrence of every unit by scanning in order."""
    first, out = {}, {}
    for i, t in sorted(set(pairs), key=lambda p: p[0]):
        flags = []
        units = [(u, "window " + " ".join(t[a:b].lower().split())) for u, (a, b) in enumerate(unit_spans(t or ""))]
        for u, body in units + [(u, "block " + x) for u, x in own_blocks(t or "")]:
            seen = first.setdefault(body, (i, u))
            if seen != (i, u):
                flags.append({"u": u, "source": seen[0]})
        out[i] = cut(t, flags, MIN_WORDS)
    return out


def sentences(rng, words, n):
    return " ".join(words(rng, rng.randint(3, 30)) + rng.choice([".", "!", "?"]) for _ in range(n))


def test_equals_brute_force(make_docs, words):
    rng = random.Random(5)
    shared = [sentences(rng, words, 6) for _ in range(5)]
    pairs = []
    for i in range(60):
        parts = [sentences(rng, words, rng.randint(1, 4)) for _ in range(3)]
        if i % 3:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        pairs.append((i, rng.choice(["\n", " ", " \n\n"]).join(parts)))
    want = brute(pairs)
    got = dedup_substrings(make_docs(pairs)).collect()
    assert {r.doc_id: (r.text, [tuple(s) for s in r.removed]) for r in got} == want
    originals = dict(pairs)
    for r in got:  # offsets point into the original; what is left is the rest
        t, at, rest = originals[r.doc_id], 0, ""
        for s in r.removed:
            assert len(t[s.begin:s.end].split()) >= BLOCK_WORDS and s.source < r.doc_id
            rest, at = rest + t[at:s.begin], s.end
        assert rest + t[at:] == r.text


def test_passage_in_the_middle_of_a_line(make_docs, words):
    rng = random.Random(11)
    passage = sentences(rng, words, 8)
    pairs = [(i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(6)]
    got = {r.doc_id: r for r in dedup_substrings(make_docs(pairs)).collect()}
    assert got[0].removed == [] and got[0].text == pairs[0][1]
    for i in range(1, 6):
        assert len(got[i].text.split()) < 40 + 40 and len(got[i].removed) == 1


def test_passage_without_marks(make_docs, words):
    rng = random.Random(12)
    passage = words(rng, 120)
    pairs = [(i, words(rng, 15) + " " + passage + " " + words(rng, 15)) for i in range(2)]
    got = {r.doc_id: r for r in dedup_substrings(make_docs(pairs)).collect()}
    assert got[0].removed == [] and len(got[1].text.split()) < 90


def test_clean_documents_stay(make_docs, words):
    rng = random.Random(13)
    pairs = [(i, sentences(rng, words, 12) + " Of the. And so it was. The end.") for i in range(40)]
    got = dedup_substrings(make_docs(pairs)).collect()
    assert {(r.doc_id, r.text) for r in got} == set(pairs)


def test_hard_rows(make_docs, hard):
    got = dedup_substrings(make_docs(hard)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in hard)
    rest = [(i, t) for i, t in hard if i != 9]
    assert Counter((r.doc_id, r.text) for r in got if r.doc_id != 9) == Counter(rest)
    long = next(r for r in got if r.doc_id == 9)
    assert len(long.text) < 5000  # one text repeating itself


def test_columns_and_empty_table(make_docs):
    assert dedup_substrings(make_docs([])).collect() == []
    docs = make_docs([(1, "a b c")]).withColumns({"d": F.lit(1), "units": F.lit(2), "h": F.lit("x")})
    out = dedup_substrings(docs)
    assert out.columns == [*docs.columns, "removed"] and out.first().units == 2


def test_no_passage_of_51_words_stays(words):
    rng = random.Random(17)
    for n in range(1500):
        w = words(rng, 51) if n % 3 else " ".join(rng.choice(["so", "on", "and", "Then"]) for _ in range(51))
        if n % 2:
            w = w.replace(" ", ". ", rng.randint(1, 20)).replace(". ", ", ", rng.randint(0, 5))
        texts = [f"{words(rng, rng.randint(0, 40))} {w} {words(rng, rng.randint(0, 40))}" for _ in range(2)]
        out = brute([(1, texts[0]), (2, texts[1].replace(" ", "\n", rng.randint(0, 30)))])
        assert sum(len(texts[1][a:b].split()) for a, b, s in out[2][1] if s == 1) >= MIN_WORDS, texts


def test_short_and_long_repeats(make_docs, words):
    rng = random.Random(18)
    far = " ".join("x" * 40 + str(rng.random()) for _ in range(20))  # 20 words, over 1,000 characters
    pairs = [(1, "Thank you."), (2, "thank  you."), (3, "He said: thank you. And left."), (4, far + " one two"),
             (5, far + " three four")]
    got = {r.doc_id: r for r in dedup_substrings(make_docs(pairs)).collect()}
    assert got[2].text == "" and [tuple(s) for s in got[2].removed] == [(0, 11, 1)]
    assert got[1].text == pairs[0][1] and got[3].text == pairs[2][1] and got[4].text == pairs[3][1]
    assert len(got[5].text) < 700 and got[5].removed[0].source == 4


def test_lines_and_paragraphs(make_docs, words):
    """A repeated line or paragraph of 10 or more words goes, however it is broken into
    lines; shorter ones and sentences inside other lines stay."""
    rng = random.Random(19)
    line, short, para = words(rng, 10), words(rng, 9), [words(rng, 6), words(rng, 8)]
    pairs = [(1, f"{words(rng, 12)}\n{line}\n{words(rng, 8)}\n{short}\n\n{words(rng, 9)}\n\n" + "\n".join(para) + "\n\nEnd one."),
             (2, f"{words(rng, 12)}\n  {line.upper()} \n{words(rng, 8)}\n{short}\n\n{words(rng, 9)}\n\n" + "  ".join(para) + "\n\nEnd two."),
             (3, f"{words(rng, 12)} {line} {words(rng, 12)}")]
    got = {r.doc_id: r for r in dedup_substrings(make_docs(pairs)).collect()}
    assert got[1].text == pairs[0][1] and got[3].text == pairs[2][1]
    parts = pairs[1][1].split("\n")
    assert got[2].text == "\n".join([parts[0], "  " + "\n".join(parts[2:6]), "", "End two."])
    assert [s.source for s in got[2].removed] == [1, 1]


def test_blocks_equal_plain_ones(words):
    rng = random.Random(20)
    for _ in range(300):
        t = "".join(rng.choice([words(rng, rng.randint(1, 14)), "\n", "\n\n", " ", "\t\n", "x\r"]) for _ in range(12))
        assert blocks(t) == sorted(own_blocks(t), key=lambda b: blocks(t).index(b))
