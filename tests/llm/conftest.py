import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, h double, slot string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and extra columns with the names operators use inside."""
    long = " ".join(f"w{i % 997} and the other" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"), (2, "the cat sat on the mat and looked at the dog", "en", "b"), (3, "the  cat sat on the mat and\tlooked at the dog", None, "b"),
        (4, "", "en", "a"), (5, None, None, None), (None, "the cat sat on the mat and looked at the dog", "en", "a"), (6, " \n\t ", "de", "c"),
        (7, long, "en", "a"), (8, long + " end", "en", None), (9, "der hund und die katze sitzen auf der matte", "de", "c"), (9, "der hund und die katze sitzen auf der matte", "de", "c"),
        (10, "?? 123 !!", "en", "a"), (11, "A", "en", "z\U0001f600"), (12, "line one is here and it is long enough\nline two\n\nline one is here and it is long enough!", "en", "z"),
    ]
    return spark.createDataFrame([(*r, None, "x", 1, 0.5, "y") for r in rows], DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
