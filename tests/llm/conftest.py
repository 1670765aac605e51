import random

import pytest

CLASHING = ["tag", "node", "n", "key", "hits", "lines", "size", "src", "p", "hash", "block", "root", "row", "target"]


@pytest.fixture()
def make_docs(spark):
    """A documents table from (doc_id, text[, lang, source]) with extra columns named like internal ones."""
    def make(rows):
        full = [(*r, *("en", "src0")[len(r) - 2:]) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in full], schema)
    return make


@pytest.fixture()
def words():
    """Random texts over a small vocabulary."""
    def make(rng: random.Random, n: int, vocabulary: int = 400) -> str:
        return "".join(f"w{rng.randrange(vocabulary)}" + rng.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    return make
