import random

from postcast.llm.token_counts import PieceCounter, count_tokens, marked_pieces, pieces_of_words


def greedy(pieces, word, longest=100):
    if len(word) > longest:
        return 1
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    for _ in range(1500):
        pieces = {draw(4) for _ in range(rng.randint(1, 6))} | {"##" + draw(4) for _ in range(rng.randint(1, 6))}
        counter = PieceCounter(sorted(pieces))
        for _ in range(8):
            w = draw(12)
            assert counter.word(w) == greedy(pieces, w), (pieces, w)


def test_long_and_unknown_words():
    c = PieceCounter(["a", "##a"])
    assert c.word("a" * 100) == 100 and c.word("a" * 101) == 1 and c.word("ab") == 1
    assert c.count("aa, b") == 2 + 1 + 1


def test_marked_vocabulary():
    assert pieces_of_words(["▁the", "ing", "▁", "##x"]) == ["the", "##ing", "####x"]


def test_hard_rows(spark, make_docs, hard):
    got = [tuple(r) for r in count_tokens(make_docs(hard), ["a", "word", "##s"]).collect()]
    assert len(got) == len(hard)
    by = dict(got)
    assert by[1] == by[2] == by[3] == 0 and by[4] == 1 and by[7] == 9 and by[9] == 40000


def test_empty_table(spark, make_docs):
    assert count_tokens(make_docs([]), ["a"]).collect() == []


def real_vocabulary():
    import sentencepiece
    from postcast.llm.queries import vocabulary
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]


def greedy_marked(listed, word):
    """Greedy search over the vocabulary as it is, with the mark before the word."""
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in listed), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_numbers_and_other_scripts():
    listed = real_vocabulary()
    pieces = set(listed)
    counter = PieceCounter(marked_pieces(listed), begin="▁")
    rng = random.Random(8)
    chars = sorted({c for p in listed for c in p if c.isalnum()})
    drawn = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for w in ["2024", "7", "ñandú", "Être", "Ελλάδα", "Москва", "العربية", "漢字", "the", "x\u0378", "▁", "%", *drawn]:
        assert counter.word(w) == greedy_marked(pieces, w), w
    assert counter.word("2024") == 5 and counter.word("Москва") > 1 and counter.word("x\u0378") == 1


def test_mark_that_is_no_piece():
    c = PieceCounter(marked_pieces(["▁the", "th", "1", "2", "▁▁"]), begin="▁")
    assert [c.word(w) for w in ("the", "12", "th1", "x")] == [1, 2, 2, 1]


def test_words_of_any_length(spark, make_docs):
    docs = make_docs([(1, "a" * 100_000), (2, "ab" * 60 + " a"), (3, "7" * 5000)])
    assert dict(tuple(r) for r in count_tokens(docs, ["a", "##a"]).collect()) == {1: 100_000, 2: 2, 3: 1}
    pieces = marked_pieces(real_vocabulary())
    assert dict(tuple(r) for r in count_tokens(docs, pieces, begin="▁").collect())[3] == 5001
