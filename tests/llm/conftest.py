import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) pairs."""
    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)
    return make


# Hard rows for every operator: nulls, empty and blank texts, repeated rows,
# equal ids with different texts, marks only, and a long text.
HARD = [(None, None), (None, "a null id with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "word"),
        (5, "same row twice here"), (5, "same row twice here"), (6, "one id"), (6, "another text of that id"),
        (7, "!!! ... ???"), (8, "é ñ ß ü 漢字 🙂   x"), (9, "lorem ipsum dolor sit amet " * 8000)]


@pytest.fixture(scope="session")
def hard():
    return HARD


@pytest.fixture(scope="session")
def words():
    """Seeded prose: words(rng, n) gives n invented words."""
    syllables = "ta re mo li su ne ka do vi pe".split()

    def make(rng, n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return make
