import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from slotforge.llm import langid

SF = "/root/testdata/sf0.01"


def plain_bits(trees, raw):
    """Code length by the definition, byte by byte; trees[context] counts next bytes."""
    total, past = 0.0, b"\n\n\n"
    symbols = langid_symbols
    for byte in raw:
        bits, order = 0.0, 3
        while order >= 0:
            seen = trees.get(past[len(past) - order :] if order else b"")
            if seen:
                n, d = sum(seen.values()), len(seen)
                if byte in seen and byte in symbols:
                    bits += -math.log2(seen[byte] / (n + d))
                    break
                bits += -math.log2(d / (n + d))
            order -= 1
        else:
            bits += 8.0
        total, past = total + bits, (past + bytes([byte]))[-3:]
    return total


langid_symbols = set()


def test_table_holds_exact_code_lengths():
    texts = {"a": ["abab abba é", "aab\n\nb"], "b": ["xyzzy xyz", "b"]}
    grams, langs, counts = [], [], []
    trees = {k: defaultdict(Counter) for k in texts}
    for i, (lang, own) in enumerate(texts.items()):
        for t in own:
            raw = b"\n\n\n" + t.encode()
            for p in range(3, len(raw)):
                grams.append(int.from_bytes(raw[p - 3 : p + 1], "big"))
                langs.append(i)
                counts.append(1)
                langid_symbols.add(raw[p])
                for order in range(4):
                    trees[lang][raw[p - order : p]][raw[p]] += 1
    model = langid.Model(["a", "b"], np.array(grams), np.array(langs), np.array(counts))
    for text in ["abba", "xyz ab", "", "b\nb\nb", "q", "éab", "aXb"]:
        raw = text.encode()
        got = model.bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        for k, lang in enumerate(texts):
            known = all(b in langid_symbols for b in raw)
            if known:
                assert abs(got[k] - plain_bits(trees[lang], raw)) < 1e-3 * max(1, got[k]), (text, lang)
    both = b"abbaxyz"
    split = model.bits(np.frombuffer(both, np.uint8), np.array([0, 4, 4, 7]), most=3)
    assert np.allclose(split[0], model.bits(np.frombuffer(b"abba", np.uint8), np.array([0, 4]))[0]) and (split[1] == 0).all()
    assert np.allclose(split[2], model.bits(np.frombuffer(b"xyz", np.uint8), np.array([0, 3]))[0])


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.where(~langid.is_held_out(docs["doc_id"])))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_undetermined_texts(spark, model, nothing):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ² _ !"), (4, "日本"), (None, "the and of"), (6, "the and of")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[4].lang_pred != "und" and rows[None].lang_pred == rows[6].lang_pred == "en"
    assert langid.predict(nothing, model).count() == 0 and langid.train(nothing) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_prediction_reads_the_text_alone(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    shifted = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect())
    b = sorted((r.doc_id - 10_000, r.lang_pred, r.score) for r in langid.predict(shifted, model).collect())
    assert a == b


def test_accept_passes_all_columns_on(spark, model):
    rows = [(1, "the and of", None, 7, 1), (1, "12", "en", 8, 2), (None, "der und die das", "xx", 9, 3), (2, None, "en", 1, 4), (1, "the and of", None, 7, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, __letter int")
    found = sorted(map(tuple, langid.accept(df, model).collect()), key=str)
    assert found == sorted([(1, "the and of", "en", 7, 1)] * 2 + [(None, "der und die das", "de", 9, 3)], key=str)
    assert langid.accept(df, model).columns == df.columns and langid.accept(df, None).count() == 0
