import pytest

LONG = ("word " * 9 + "x" * 37 + "\n") * 2000
ODD = [
    (1, "plain text with some words in it", "en", "s0", 5),
    (2, None, "en", "s1", 0),
    (3, "", None, None, 0),
    (4, " \t\r\n  ", "en", "s2", 1),
    (5, LONG, "en", "s3", 9),
    (6, "plain text with some words in it", "en", "s4", 5),
    (6, "plain text with some words in it", "en", "s4", 5),
    (7, "é漢字 \U0001f600 ＡＢＣ \x85 \u2028 mail a.b@c.de ip 1.2.3.4 call +1 (234) 555-6789", "fr", "s5", 3),
    (8, "x" * 5000, "en", "s6", 2),
    (9, "\n\n\n", "en", "s7", 2),
    (None, "text without id", "en", "s8", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns whose names operators use themselves."""
    rows = [(*r, 1, "k", 2.0, "b", [1]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, block string, score double, rep string, prints array<int>")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
