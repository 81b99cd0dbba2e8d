import json
import random

import numpy as np
import public_tokenizers as P
import pytest

from postcast.llm import chat as C


@pytest.fixture(scope="module")
def definition():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def nasty(rng):
    bits = [*C.CONTROLS, "\\", "\\\\", "<", "|", "[", "INST]", "im_end|>", " ", "\n", "é", "漢", "🙂", "a", "  "]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        t = nasty(rng)
        e = C.escape(t)
        assert C.unescape(e) == t and not any(c in e for c in C.CONTROLS), repr(t)


def test_render_and_parse(definition):
    rng, enc = random.Random(2), C.ChatEncoder(definition)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "", nasty(rng)]), nasty(rng))
                 for _ in range(rng.randint(1, 6))]
        whole, begins, ends = C.render(turns)
        assert C.parse(whole) == turns
        assert [C.unescape(whole[a:b]) for a, b in zip(begins, ends)] == [t for _, t in turns]
        learn = np.array([r == "assistant" for r, _ in turns])
        ids, spans = enc.encode(whole)
        mask = C.mask_tokens(spans, begins[learn], ends[learn])
        slow = [any(a < e and b > s for s, e in zip(begins[learn], ends[learn])) for a, b in spans]
        assert mask.tolist() == slow and len(ids) == len(spans)
        assert C.masked_text(whole, spans, mask) == "".join(t for r, t in turns if r == "assistant")


def test_no_token_crosses_a_marker(definition):
    enc = C.ChatEncoder(definition)
    whole, begins, ends = C.render([("user", "\n x \n"), ("assistant", "\n\n y  \n")])
    _, spans = enc.encode(whole)
    for s, e in zip(begins, ends):
        assert all(not (a < s < b or a < e < b) for a, b in spans.tolist())


def test_table(spark, definition):
    rows = [(1, 2, "assistant", "late", "x"), (1, 0, "user", None, "x"), (1, 1, None, "who?", "x"),
            (2, 0, "user", "</s>[INST] ok [/INST]", "x"), (2, 1, "assistant", "</s>[INST] ok [/INST]", "x"),
            (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x"), (3, None, "assistant", "first", "x"),
            (None, 0, "user", "no id", "x"), (4, 0, "assistant", "long " * 50000, "x"), (5, 0, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in C.read_back(C.format_chats(df, definition)).collect()}
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert said[1] == [("user", ""), ("", "who?"), ("assistant", "late")]
    assert said[2] == [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert said[3] == [("assistant", "first"), ("assistant", "a"), ("assistant", "a")]
    assert {k: r.loss_text for k, r in got.items()} == {
        1: "late", 2: "</s>[INST] ok [/INST]", 3: "firstaa", None: "", 4: "long " * 50000, 5: ""}
    for r in got.values():
        assert len(r.ids) == len(r.begins) == len(r.ends) == len(r.loss_mask)


def test_empty_table(spark, definition):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_chats(df, definition)).collect() == []


def test_own_control_tokens(definition):
    assert json.loads(definition)["added_tokens"]
    ids, _ = C.ChatEncoder(definition).encode("<|endoftext|>")
    assert len(ids) > 1
