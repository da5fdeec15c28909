"""Rows with everything that may go wrong, as fixtures to import."""

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, digest string, bucket int, `a.b` int"


def sentence(i: int, n: int = 40, words: str = "stone river cloud amber field lantern quiet morning paper copper meadow signal winter garden ladder") -> str:
    w = words.split()
    return " ".join(w[(i * 7 + j * j + j * (i % 5 + 1)) % len(w)] + ("" if j % 9 else f"{i}x{j}") for j in range(n)) + "."


def rows():
    """Nulls, empty and white texts, a long text, ties, repeated rows, exact and near copies, odd characters."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
    base = sentence(1, 120)
    texts = [None, "", " \n\t ", "one", "a b c", long, base, base, base.upper(), base + " more", base.replace("river", "rivers", 1),
             "tab\tand\x0bvertical\x1cunit sep  two <|endoftext|> end", "naïve café É ß œ ½ ² 東京 \U0001f600 é", "</s>[INST] x [/INST]",
             "x" * 5000, "​​", "12345 67890 ...", *[sentence(i, 30 + i) for i in range(2, 24)]]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], 0, 1, 2, "d", 3, 4) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (6, "another text under the same id", "en", "a", 0, 1, 2, "d", 3, 4), (None, "no id here at all", "en", "a", 0, 1, 2, "d", 3, 4),
                  (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and further columns whose names the operators use themselves."""
    return spark.createDataFrame(rows(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SHAPE)
