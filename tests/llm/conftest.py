import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x int"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and short texts, copies, near copies, shared passages, repeated rows and a long text."""
    rng = random.Random(5)
    passage = words(rng, 70)
    texts = [words(rng, rng.randrange(1, 160)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7], None, "", " \n\t ", "one", "two words", "Caps ONE two", "caps one TWO"]
    for k in (8, 9, 10, 11):
        own = texts[k].split()
        if own:
            own[len(own) // 2] = "changed"
        texts.append(" ".join(own))
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 20) for _ in range(6)]
    texts += [passage, passage + "\n" + words(rng, 5), words(rng, 6000), passage + " " + passage]
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[3], (None, "a null id here", "en", "s", 14, 1), (None, texts[3], None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
