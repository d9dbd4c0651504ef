import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slotforge.llm import collocation
from slotforge.llm.collocation import Counts, Transducer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = st.lists(st.sampled_from([b"a", b"b", "é".encode(), b"the", b"x|y"]), min_size=1, max_size=5).map(tuple)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(WORDS, st.integers(1, 10**12), min_size=1, max_size=60))
def test_transducer_round_trip(counts):
    back = Counts(Transducer.of(counts))
    assert list(back.items()) == sorted(counts.items())
    assert all(back.get(w) == n for w, n in counts.items())
    assert back.get((b"none",)) is None and back.get((b"a",) * 9) is None


def test_equal_ends_are_one_state():
    counts = {(bytes([97 + i]), b"of", b"the", bytes([97 + j])): 100 + j for i in range(20) for j in range(20)}
    made = Transducer()
    for words in sorted(counts):
        made.add(words, counts[words])
    made.to_bytes()
    assert len(made.states) < 30


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, least, top, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            own = "und" if lang is None else lang
            n[own] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[own][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {w: a for w, a in counts.items() if a >= least and len(w) > 1}
        inside = lambda w, v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        ranked = []
        for w, a in found.items():
            if any(len(v) > len(w) and b >= a and inside(w, v) for v, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            ranked.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def made(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "THE", "the", "x|y", "\x01odd"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["All rights reserved by the owner", "in spite of", "ha ha ha ha"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 9))))
            parts.append(rng.choice([". ", ", ", "\n", "\t", " ", "  ", ";", "!?", "\x0b"]))
        rows.append((i, "".join(parts), rng.choice(["en", "en", "en", "fr", None, "", "und"]), "s", 1))
    return [*rows, rows[3], rows[3], (None, None, "en", None, None), (7, "", None, "s", 0), (8, "the of " * 3000, "en", "s", 1), (9, " .,\n ", "de", "s", 1)]


@pytest.mark.parametrize("least,top,longest", [(5, 2000, 5), (20, 10, 5), (8, 2000, 3), (5, 50, 2)])
def test_brute_force(spark, least, top, longest):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in collocation.mine(docs, least=least, top=top, longest=longest).collect()) == brute(rows, least, top, longest)


def test_counters_that_are_written_often(spark, monkeypatch):
    monkeypatch.setattr(collocation, "HELD", 10)
    monkeypatch.setattr(collocation, "LOOKUPS", 2)
    rows = made(5)
    assert sorted(tuple(r) for r in collocation.mine(spark.createDataFrame(rows, SCHEMA).repartition(2), least=5).collect()) == brute(rows, 5, 2000)


def test_pieces():
    pieces = collocation.Pieces(pa.array(["One two.three\tfour", None, "", "five,six seven "]), ["en"] * 4)
    assert pieces.room.tolist() == [2, 1, 2, 1, 1, 2, 1]
    assert pieces.counts.tolist() == [4, 0, 0, 3]
    assert len(set(pieces.keys(1).tolist())) == 7


def test_phrases_of_one_key_are_told_apart(spark, monkeypatch):
    """Keys that all collide: the second hash separates them, and the filters let everything pass."""
    keys = collocation.Pieces.keys
    monkeypatch.setattr(collocation.Pieces, "keys", lambda self, size: keys(self, size) & collocation._U(3))
    pieces = collocation.Pieces(pa.array(["a b a b c d", "a b. c"]), ["en", "fr"])
    first, n = pieces.groups(1, pieces.starts.argsort())
    found = sorted((bytes(pieces.data[pieces.starts[k] : pieces.ends[k]]), int(pieces.row()[k]), times) for k, times in zip(first.tolist(), n.tolist(), strict=True))
    assert found == [(b"a", 0, 2), (b"a", 1, 1), (b"b", 0, 2), (b"b", 1, 1), (b"c", 0, 1), (b"c", 1, 1), (b"d", 0, 1)]


def test_scores_pass_64_bits(spark):
    row = [("en", [b"a", b"b"], 2, 4 * 10**12, 1, 5 * 10**12, 6 * 10**12)]
    cuts = spark.createDataFrame(row, collocation.CUTS)
    words = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    assert collocation.scored(cuts, words).first().cut.score == 1000 * 4 * 10**12 * 10**14 // (5 * 10**12 * 6 * 10**12)


def test_clashing_columns_and_empty_table(spark, nothing):
    docs = spark.createDataFrame([("a b", "en", b"x", 1, 2)] * 6, "text string, lang string, prefix binary, n long, salt int")
    assert [tuple(r) for r in collocation.mine(docs, least=5).collect()] == [("en", 1, "a b", 6, 6, 6, 12, 2000)]
    assert collocation.mine(nothing).collect() == []
