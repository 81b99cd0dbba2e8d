import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postcast.llm import alignment as AL


@pytest.fixture(scope="module")
def files():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


@pytest.fixture(scope="module")
def libraries(files):
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=files[1])


def plain(text, libraries):
    """(groups, links) of one text by loops over the bytes; None without tokens."""
    a, b = libraries
    if not text:
        return None
    body = (" " + text).encode()
    alphabet = AL.byte_alphabet()
    one = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(t for _, t in left) != body or b"".join(t for _, t in right) != body:
        return None

    def places(tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out
    left, right = places(left), places(right)
    cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
    groups, start = [], 0
    for c in cuts:
        groups.append(([i for i, x, y in left if start <= x < c], [i for i, x, y in right if start <= x < c]))
        start = c
    links = [(i, j) for g, h in [((left), (right))] for i, x, y in g for j, u, v in h if x < v and u < y]
    return groups, links


def brute(texts, libraries):
    done = {t: plain(t, libraries) for t in set(texts)}
    count = Counter()
    for t in texts:
        if done[t]:
            count.update(set(done[t][1]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for t in texts:
        if not done[t]:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = done[t]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return out


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def strings(seed, n):
    rng = random.Random(seed)
    words = ["the", "Übung", "naïve", "don't", "x", "漢字", "🙂", "1234", "a_b", "...", "word\n\nnext", "tab\tin",
             "<|endoftext|>", "</s>", "<0x41>", "é", "​z", "\xa0", "\x85q", "\x1cr", "ﬁ", "\0"]
    for _ in range(n):
        kind = rng.random()
        if kind < .5:
            yield " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        elif kind < .7:
            yield "".join(rng.choice(["a", " ", "\n", "b ", "  ", "é", "▁", "\t"]) for _ in range(rng.randint(0, 12)))
        else:
            yield "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FF), rng.randint(0x3000, 0x9FFF)]))
                          for _ in range(rng.randint(1, 25)))


@pytest.mark.parametrize("limit", [AL.BROADCAST_PAIRS, 0])
def test_equals_brute_force(make_docs, files, libraries, hard, limit):
    texts = list(strings(1, 250))
    texts += texts[:40] + [t for _, t in hard if not t or len(t) < 1000] + [None, "", " ", "▁x y", "one two"]
    docs = make_docs(list(enumerate(texts))).withColumns({"key": F.lit(1), "pair": F.lit(2), "n_a": F.lit(3)})
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in AL.align(docs, *files, broadcast_pairs=limit).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, libraries)


def test_parts_equal_whole_texts(files):
    """Remembered parts, in whatever batches and with a tiny memory, give what the
    text on its own gives."""
    one = AL.Aligner(*files, most=5)
    texts = list(strings(2, 1500))
    assert one.by_parts
    got = list(one.texts(texts[:700])) + [x for t in texts[700:] for x in one.texts([t])]
    for t, g in zip(texts, got):
        want = one.direct(t)
        if want is None:
            assert g is None
        else:
            assert all(np.array_equal(x, y) for x, y in zip(g, want)), repr(t)


def test_long_texts(files):
    one = AL.Aligner(*files)
    long = ["a" * 30_000, "word " * 20_000 + "end", "漢" * 5_000, "ab\n" * 9_000 + "x"]
    for t, g in zip(long, one.texts(long)):
        want = one.direct(t)
        assert all(np.array_equal(x, y) for x, y in zip(g, want))


def test_hard_rows_and_empty_table(make_docs, files, hard):
    got = AL.align(make_docs(hard), *files)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in hard)
    assert AL.align(make_docs([]), *files).collect() == []
    assert rows(AL.align(make_docs([(1, None), (None, "")]), *files)) == [(0, 0, 0, 0, 0, 0, "")] * 2
