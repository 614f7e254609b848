import random

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (text, lang, source) rows, with ids from 0."""

    def make(*texts, lang="en", first=0):
        rows = [(first + i, t, lang, "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return make


def words(r: random.Random, n: int, vocab: int = 500) -> str:
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))
