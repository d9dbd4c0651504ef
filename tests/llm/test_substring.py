import hashlib

import pytest
from slotforge.llm import substring

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(corpus, width):
    first = {}
    for row in corpus:
        words = split(row[1])
        for p in range(len(words) - width + 1 if row[0] is not None else 0):
            key = tuple(words[p : p + width])
            first[key] = min(first.get(key, row[0]), row[0])
    out = []
    for row in corpus:
        words = split(row[1])
        gone = [False] * len(words)
        for p in range(len(words) - width + 1 if row[0] is not None else 0):
            if first[tuple(words[p : p + width])] < row[0]:
                gone[p : p + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((row[0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [50, 10, 3, 2, 1])
def test_brute_force(docs, corpus, width):
    found = substring.remove_repeats(docs, width)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(corpus, width)


def test_partial_overlaps(spark):
    base = [f"a{i}" for i in range(300)]
    rows = [(9, " ".join(base)), (1, " ".join(base[40:110])), (2, " ".join(base[100:170] + ["x"] + base[171:260])), (3, " ".join(base[60:90] * 3)), (4, " ".join(base[60:90] * 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring.remove_repeats(df, 20).collect()), key=str) == brute(rows, 20)


def test_empty_table(nothing):
    assert substring.remove_repeats(nothing).count() == 0


def test_one_id_with_many_texts_and_clashing_columns(spark):
    passage = [f"p{i}" for i in range(30)]
    rows = [(5, " ".join([f"d{k}_{i}" for i in range(12)] + passage + [f"e{k}"]), 1, 2) for k in range(25)] + [(1, " ".join(passage), 1, 2), (5, "d3_0", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, anchor int, rid int")
    assert sorted((tuple(r) for r in substring.remove_repeats(df, 20).collect()), key=str) == brute(rows, 20)
