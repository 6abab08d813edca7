import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, shard string, fp string, hit_id int, key string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omikron", "pi", "rho"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long_ = text(40), text(30_000)
    texts = [None, "", " \t\n", "one", "one two", shared, shared, text(10) + "\n" + shared + " " + text(10), long_, long_ + " end", "<|endoftext|> x  y  z", "###  $$$\n\n###  $$$", "1234 5678", "Licensed under CC BY-NC 4.0.\nAll rights reserved. cc by cc by",
             "a " * 50, text(200), "é" * 5000, "x" * 70_000, "This work is under the GNU General Public License, version 3."]
    rows = [(k, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 7 == 3 else f"src{k % 3}", None if k == 4 else len(t or ""), k, "s", None, k, "k") for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, shared, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "another text of the same id", "en", "src0", 1, 1, "s", "f", 1, "k")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
