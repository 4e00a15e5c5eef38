import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 int, fingerprint string, N_TOKENS string, kept string, contaminated int, held_out string, root string, id long, h string"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, odd characters, columns that clash with results."""
    rng = random.Random(5)
    long = words(rng, 20_000)
    texts = [
        "a b c d", None, "", "   ", "one", "one two", "One TWO", "One TWO", long, long, long + " tail", words(rng, 300), "x" * 3000, "naïve façade ñ ß", "日本語 テキスト ſ", "<|endoftext|> <s> </s>", "a  b\n\n c ▁d  ",
        "\n lead", "tab\tand\r\nbreak\x0b\x0c\x1c\x85\xa0", words(rng, 90), "don't we'll I'm 123 4567",
    ]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if i != 3 else None, t, [None, "en", "de"][i % 3], None if i % 4 == 0 else "s", None if i % 5 == 0 else 7, "q", i, "f", "n", "k", 1, "h", "r", i, "h"))
    rows += [rows[8], rows[0], (0, "another with a used id", None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rng():
    return random.Random(9)
