"""Language identification by prediction by partial matching (operator 8).

For each language a byte context tree of order 3 is trained: counts of each byte after each context of up to three
bytes. A byte's probability comes from the longest context that has seen it; an unseen byte costs the context's escape
probability (method C: distinct / (total + distinct)) and falls to the next shorter context, at last to a uniform
order. Statistics are frozen before scoring, so a byte's code length depends on its context alone: the trees become
one table of code lengths, indexed by context and byte, and a batch of texts is scored by look-ups. The language with
the shortest code wins; ``score`` is its posterior under a uniform prior, from the code length of each byte (at most
``evidence`` bytes' worth of it).

Training uses at most about ``sample`` documents of each language, chosen by a hash of the id (a documented bound, the
only one: it bounds the model; scoring covers all bytes of all texts). Gram counts are summed by Spark.

Cases: null text, or text without a letter, is ``und`` with score 0; of languages with equal code lengths the first by
name wins; rows are judged alone, so repeated rows and null
ids get results of their own; with nothing to learn from all is ``und``; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops

ORDER = 3
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def _grams(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each byte, it and the three before it, the oldest highest; a text starts after line ends."""
    padded = np.full(len(data) + ORDER * (len(rows) - 1), 10, np.uint32)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(rows)), np.diff(rows))
    padded[at] = data
    gram = padded[at - 3] << 24 | padded[at - 2] << 16 | padded[at - 1] << 8 | padded[at]
    return gram


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the rows of (lang, text), where a language is a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy()
            for lang in np.unique(langs).tolist():
                own = batch.filter(pa.array(langs == lang))
                for part in textops.slices(own, 1):
                    gram, n = np.unique(_grams(*textops.buffers(part.column(1))), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return docs.mapInArrow(textops.releasing(run), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits: ``cost[context * symbols + symbol]`` has a column for each language.

    The table is filled by parts of the contexts, so that building it takes little more than the table itself.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, lang: np.ndarray, n: np.ndarray, part: int = 2048):
        self.langs = langs
        seen = np.unique(grams & 0xFF)
        self.symbol = np.zeros(256, np.int32)  # 0: bytes that no language has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = size = len(seen) + 1
        oldest, older, old, last = (self.symbol[(grams >> s) & 0xFF].astype(np.int64) for s in (24, 16, 8, 0))
        # codes of the contexts of each order, the newest byte lowest
        codes = [np.zeros(len(grams), np.int64), old, old + size * older, old + size * older + size * size * oldest]
        levels = [np.unique(c) for c in codes]
        first = np.cumsum([0, *[len(k) for k in levels]])
        self.cost = np.empty((int(first[-1]) * size, len(langs)), np.float32)
        for order, (code, known) in enumerate(zip(codes, levels, strict=True)):
            place = np.searchsorted(known, code)
            by_place = np.argsort(place, kind="stable")
            place = place[by_place]
            for a in range(0, len(known), part):
                b = min(a + part, len(known))
                own = by_place[slice(*np.searchsorted(place, (a, b)))]
                count = np.zeros(((b - a) * size, len(langs)))
                np.add.at(count, ((np.searchsorted(known, code[own]) - a) * size + last[own], lang[own]), n[own])
                count = count.reshape(b - a, size, len(langs))
                if order:
                    shorter = first[order - 1] + np.searchsorted(levels[order - 1], known[a:b] % size ** (order - 1))
                    below = self.cost.reshape(-1, size, len(langs))[shorter]
                else:
                    below = np.full(count.shape, 8.0)
                total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = -np.log2(count / (total + distinct))
                    escape = np.where(total > 0, -np.log2(np.where(total > 0, distinct / (total + distinct), 1)), 0)
                self.cost[(first[order] + a) * size : (first[order] + b) * size] = np.where(count > 0, found, escape + below).reshape(-1, len(langs))
        # each order-3 code leads to its longest known context
        self.where = np.zeros(size**ORDER, np.int32)
        for order, known in enumerate(levels):
            for a in range(0, len(self.where), 1 << 20):
                short = np.arange(a, min(a + (1 << 20), len(self.where))) % size**order
                at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                hit = np.flatnonzero(known[at] == short)
                self.where[a + hit] = ((first[order] + at[hit]) * size).astype(np.int32)

    def bits(self, data: np.ndarray, rows: np.ndarray, most: int = 1 << 17) -> np.ndarray:
        """The code length of each text in each language."""
        out = np.zeros((len(rows) - 1, len(self.langs)))
        s = self.symbol[data]
        start = np.zeros(len(data), bool)
        start[rows[:-1][rows[:-1] < len(data)]] = True
        line = self.symbol[10]
        for first in range(0, len(data), most):
            last = min(first + most, len(data))
            at = np.arange(first, last)
            since = at - rows[np.searchsorted(rows, at, "right") - 1]
            a, b, c = (np.where(since >= k, s[np.maximum(at - k, 0)], line) for k in (1, 2, 3))
            cost = self.cost[self.where[a + self.size * b + self.size * self.size * c] + s[first:last]]
            bounds = np.clip(rows, first, last) - first
            total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(cost, axis=0, dtype=np.float64)))
            out += total[bounds[1:]] - total[bounds[:-1]]
        return out


def train(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = 2000) -> Model | None:
    """The frozen model, or None where no row has a language and a text."""
    rows = textops.keyed(docs, {"doc_id": id_column, "text": text_column, "lang": lang_column}).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return None
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    chosen = rows.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)) < share)
    langs = sorted(sizes)
    number = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1
    table = count_grams(chosen.select(number.alias("lang"), "text")).toArrow()  # bounded by the sample
    return Model(langs, table.column("gram").to_numpy(), table.column("lang").to_numpy(), table.column("n").to_numpy()) if table.num_rows else None


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text", evidence: int = 64) -> DataFrame:
    """The language of each text, its posterior probability and its code length."""
    rows = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 2):
                lang, score, best = _judge(shared.value, part.column(2), part.column(3), evidence)
                columns = [part.column(0).cast(pa.int64()), part.column(1), lang, pa.array(score), pa.array(best, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(textops.releasing(run), SCHEMA)


def _judge(model: Model | None, texts: pa.Array, letter: pa.Array, evidence: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Language, posterior and bits for each byte of each text."""
    known = np.array(letter.to_pylist(), bool) & (model is not None)
    if model is None:
        return pa.array(["und"] * len(known), pa.string()), np.zeros(len(known)), np.full(len(known), np.nan)
    data, at = textops.buffers(texts)
    size = np.maximum(np.diff(at), 1)
    bits = model.bits(data, at)
    least = bits.min(axis=1, keepdims=True)
    apart = (bits - least) * (np.minimum(size, evidence) / size)[:, None]
    score = np.where(known, 1 / np.exp2(-np.minimum(apart, 1000)).sum(1), 0.0)
    lang = [model.langs[k] if ok else "und" for k, ok in zip(np.argmin(bits, axis=1), known, strict=True)]
    return pa.array(lang, pa.string()), score, np.where(known, least[:, 0] / size, np.nan)


def accept(docs: DataFrame, model: Model | None, *, text_column: str = "text", lang_column: str = "lang", least: float = 0.5, evidence: int = 64) -> DataFrame:
    """The rows whose language is known with a posterior of ``least`` or more, with all their columns; theirs is set to it.

    Nothing is shuffled or joined: each row is judged and passed on where it lies.
    """
    textops.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang_at = names.index(text_column), names.index(lang_column)
    given = [F.col(f"`{c}`").cast("string").alias(c) if c == lang_column else F.col(f"`{c}`") for c in names]
    letter = F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*given, letter.alias("_".join(["letter", *names])))  # no other column's name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, text):
                lang, score, _ = _judge(shared.value, part.column(text), part.column(len(names)), evidence)
                columns = [lang if i == lang_at else part.column(i) for i in range(len(names))]
                sure = (score >= least) & np.array([x != "und" for x in lang.to_pylist()], bool)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(sure))

    return rows.mapInArrow(textops.releasing(run), docs.select(*given).schema)
