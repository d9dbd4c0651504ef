import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slotforge.llm import packing
from tokenizers import Tokenizer

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def base():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


FAST = packing.Tokenizer(JSON, RANKS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'st1  \n\t日Ω <|endoftext|>ß²"), max_size=40))
def test_both_libraries_give_the_same_ids(text):
    assert FAST(text) == np.array(FAST.base.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_windows_hold_each_item_once_and_fit(sizes):
    found = packing.windows_of(sizes, 64)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 64 for w in found)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 512, 256).tolist()
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 32)]
    assert max(loads) - min(loads) < 30


@pytest.mark.parametrize("capacity,rest", [(2048, 512), (64, 16)])
def test_each_id_lies_in_one_piece_and_sequences_have_no_gaps(docs, corpus, base, capacity, rest):
    rows = packing.pack(docs, JSON, ranks_path=RANKS, capacity=capacity, rest_piece=rest, group=16).collect()
    expected = defaultdict(list)
    for row in corpus:
        expected[row[0]].append([*base.encode(row[1] or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(expected)
    for doc, found in pieces.items():
        want = []
        for ids in expected[doc]:
            at = 0
            while at < len(ids):
                n = capacity if len(ids) - at >= capacity else min(rest, len(ids) - at)
                want.append((at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
                at += n
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(want)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_padding_is_small(spark, base):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 3000, 800))]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), JSON, ranks_path=RANKS)
    total = found.agg({"length": "sum", "sequence_id": "max"}).first()
    windows = found.select("sequence_id").distinct().count()
    assert total["sum(length)"] > 0.98 * 2048 * windows


def test_empty_table(nothing):
    assert packing.pack(nothing, JSON).count() == 0


def test_added_tokens_in_texts_have_the_ids_of_the_plain_call():
    plain = Tokenizer.from_file(JSON)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|>日"):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(FAST(text), "<u4").tolist() == want
        assert np.frombuffer(packing.Tokenizer(JSON)(text), "<u4").tolist() == want


def test_padding_of_short_texts_is_small(spark):
    rows = [(i, " ".join(["word"] * (i % 12 + 3))) for i in range(30_000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), JSON, ranks_path=RANKS)
    total, windows = found.agg({"length": "sum"}).first()[0], found.select("sequence_id").distinct().count()
    assert found.count() == 30_000 and total > 0.95 * 2048 * windows
