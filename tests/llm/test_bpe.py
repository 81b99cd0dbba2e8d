import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from postcast.llm import bpe


@pytest.fixture(scope="module")
def vocab():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(vocab.rank), special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        k, m = rng.random(), rng.randint(0, 40)
        if k < .3:
            yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(m))
        elif k < .5:
            yield "".join(rng.choice("aeot hin\n") for _ in range(2 * m))
        elif k < .8:
            yield "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FF), rng.randint(0x3000, 0x9FFF),
                                          0x1F600 + rng.randint(0, 50)])) for _ in range(m))
        else:
            yield rng.choice("a =-_*\n\t0") * m * 3 + rng.choice("ab")


def test_ids_equal_the_library(vocab, library):
    enc = bpe.Encoder(vocab, P.PATTERN)
    for t in texts(4000):
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == library.encode_ordinary(t), repr(t)


def test_every_token_encodes_to_itself(vocab):
    enc = bpe.Encoder(vocab, P.PATTERN)
    assert all(vocab.made) and all(enc.piece(t) == [i] for i, t in enumerate(vocab.tokens))


def test_small_memo_changes_nothing(vocab, library):
    enc = bpe.Encoder(vocab, P.PATTERN)
    enc.pieces.most = enc.chunks.most = enc.pairs.most = 2
    for t in texts(300, 7):
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == library.encode_ordinary(t)


def test_round_trip_of_hard_rows(spark, make_docs, hard, vocab, library):
    docs = make_docs(hard)
    enc = bpe.encode(docs, vocab, P.PATTERN, keys=["doc_id", "text"])
    got = bpe.decode(enc, vocab).collect()
    assert len(got) == len(hard)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_empty_table(spark, make_docs, vocab):
    assert bpe.decode(bpe.encode(make_docs([]), vocab, P.PATTERN), vocab).collect() == []


def test_null_ids_decode_to_nothing(spark, vocab):
    df = spark.createDataFrame([(1, None), (2, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, vocab).collect()}
    assert got == {1: b"", 2: vocab.tokens[0] + vocab.tokens[1]}
