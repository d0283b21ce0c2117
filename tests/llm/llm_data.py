"""Small tables for the tests of the text operators."""

from __future__ import annotations

import random

import pytest

WORDS = "river stone light winter paper garden music number window silver forest market letter engine circle bridge".split()


@pytest.fixture(scope="session")
def sentences():
    """Deterministic texts of invented sentences."""

    def make(n: int, seed: int, words: int = 60) -> list[str]:
        rng = random.Random(seed)
        out = []
        for _ in range(n):
            text = [rng.choice(WORDS) + rng.choice(("", "s", "ing", "ed")) for _ in range(words)]
            out.append(". ".join(" ".join(text[k : k + 9]).capitalize() for k in range(0, words, 9)) + ".")
        return out

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and columns with the operators' inner names."""
    long = "winter paper garden. " * 20_000
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "same text twice over here now"), (5, "same text twice over here now"), (None, "no id at all"), (6, long), (7, "ÄÖÜ ñandú 漢字 🙂 x")]
    rows = [(i, t, "x", i, "y") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _row string, _found bigint, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
