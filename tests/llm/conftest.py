import random

import pytest

#: Columns of documents, one that clashes with names the operators use, and null cells.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept string, id string"


def make_rows(n: int = 120, seed: int = 3) -> list[tuple]:
    """Texts with exact and near copies, repeated rows, null and empty cells and one long text."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["étion", "straße", "don't", "中文", "A,B!"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150))) for _ in range(n)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]] + ["", "", None, " ", "\n\n", "one", "one two"]
    texts += [" ".join(rnd.choice(words) for _ in range(30_000))]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
