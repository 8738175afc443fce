import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, k int, key int, bucket int, score double, epochs int, doc int, rank int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven grey geese watch from the frozen pond near the old mill"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    near = PROSE.replace("seven", "eight") + " " + PROSE
    rows = [
        (1, PROSE + " " + PROSE, "en", "b", 5),
        (2, near, "en", "b", 5),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, LONG, "en", "a", len(LONG)),
        (6, "a\n\nb c\na", "fr", "é", 8),
        (7, PROSE + " " + PROSE, "en", None, 5),
        (7, PROSE + " " + PROSE, "en", None, 5),
        (8, " \t\n ", None, "", None),
        (9, "one two\nthree", "en", "b", None),
        (None, "no id here", "en", "a", 1),
        (10, "Übung macht 'den' Meister <|endoftext|> ok it'ś x\x1cy", "de", "a", 2),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, 7, 8, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
