"""Benchmark decontamination by CGK embedding and bit sampling (operator 6).

A document is contaminated by an item if a stretch of its words is within ``ratio`` (of the item's words) edits of the
item. Windows of the item's size are embedded by the CGK random walk: at each of 3n steps the walk outputs the word it
stands at and moves on if a hash of (step, word) says so, so that edit distance becomes Hamming distance. Several
walks are taken; each samples a few output places as a key, and equal keys make a candidate. Candidates are verified
by exact edit distance of the item against the stretch around the window, ends free.

Before they are embedded, windows are screened: an item of n words within d edits shares at least n - 1 - 2d word
pairs with the stretch, and every window that holds so many in its own row is embedded: passages may stand side by
side, so none is left out for a better neighbour. At a row's ends windows reach over it, filled with blanks, by as
many words as may be missing, so a document that is an item cut short has windows as well. Pairs of items are held in
a table with a mask of size classes, and keys in another; both grow with the benchmark up to a fixed size (``MOST_PAIRS``,
``MOST_KEYS``), so they can be broadcast however large it is: where it outgrows them they let more pass, and the result
is the same. Windows of equal words are embedded once, and of equal stretches of a text the first is verified, so work on
a repetitive text is that on its words. Candidates then meet their items in a shuffled (or, if Spark finds it small,
broadcast) join.

Words are those of the text with A-Z in lower case. Cases: null or empty texts and items have no words and match
nothing; items of fewer than five words allow no edits, so an item of one word is in every text that has the word; rows
with equal or null ids are reported once for each (id, item), the stretch with the fewest edits, of several the one that
ends first; very long texts are worked off like others, by their words; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.textops import Words, mix, rolling

_U = np.uint64
CLASSES = 64
#: Windows that are embedded at a time; words that a walk goes over at most.
BLOCK, LONG = 1024, 64
#: Least and most places of the tables of word pairs and of keys: 32 MB each at most.
LEAST, MOST_PAIRS, MOST_KEYS = 1 << 20, 1 << 22, 1 << 25


def _own_blank(windows: np.ndarray) -> np.ndarray:
    """The windows with one more column, a blank that tells the row's words and their order."""
    blank = mix((windows * mix(np.arange(1, windows.shape[1] + 1, dtype=np.uint64))[None, :]).sum(axis=1, dtype=np.uint64))
    return np.concatenate((windows, blank[:, None]), axis=1)


def _turns(seed: int, steps: int) -> np.ndarray:
    """Two random numbers for each step: a walk moves on if the top bit of (word * first + second) is set."""
    return mix(np.arange(1, 2 * steps + 1, dtype=np.uint64) + mix(np.array([seed + 1], np.uint64))).reshape(steps, 2) | _U(1)


def walk(windows: np.ndarray, seed: int, steps: int | None = None) -> np.ndarray:
    """CGK embedding of rows of word hashes: (rows, n) to (rows, 3n), or the first ``steps``.

    Past its end a row gives a blank of its own, so that only equal rows agree there.
    """
    rows, n = windows.shape
    padded, steps = _own_blank(windows), 3 * n if steps is None else steps
    at, out, every = np.zeros(rows, np.int64), np.empty((rows, steps), np.uint64), np.arange(rows)
    for step, (times, plus) in enumerate(_turns(seed, steps)):
        out[:, step] = word = padded[every, at]
        at = np.minimum(at + ((word * times + plus) >> _U(63)).astype(np.int64), n)
    return out


def inner_steps(n: int) -> int:
    """Steps before which a walk of n words hardly ends: it moves k/2 of k steps, and two deviations more once in 40."""
    return max(1, int((np.sqrt(1 + 2 * n) - 1) ** 2))


def sampled(n: int, seed: int, places: int) -> np.ndarray:
    """The places of a walk that make its key; none is favoured."""
    return np.sort(np.random.default_rng((seed, n)).choice(inner_steps(n), min(places, inner_steps(n)), replace=False))


@functools.lru_cache(maxsize=1024)
def _courses(n: int, repeats: int, places: int) -> tuple[list[int], list[list[int]], np.ndarray]:
    """Seeds, those that go furthest first, with their places and random numbers."""
    chosen = {seed: sampled(n, seed, places).tolist() for seed in range(repeats)}
    order = sorted(chosen, key=lambda s: -chosen[s][-1])
    steps = chosen[order[0]][-1] + 1
    return order, [chosen[s] for s in order], np.stack([_turns(s, steps) for s in order])


def keys(windows: np.ndarray, repeats: int, places: int) -> np.ndarray:
    """(walks, rows): a hash of sampled places of each walk; windows of other sizes have other keys.

    A walk loses its step with every edit, so that far places of a long window hardly agree. Windows of more than
    ``LONG`` words take their walks from the beginning, from the middle, and from the end backwards, each over as many
    words: ``repeats`` of each, so that recall does not fall with the size.
    """
    n = windows.shape[1]
    if n <= LONG:
        return _keys(windows, n, repeats, places, 0)
    parts = windows[:, :LONG], windows[:, n // 2 : n // 2 + LONG], windows[:, : -LONG - 1 : -1]
    return np.concatenate([_keys(part, n, repeats, places, k) for k, part in enumerate(parts)])


def _keys(windows: np.ndarray, size: int, repeats: int, places: int, part: int) -> np.ndarray:
    """Keys of walks over these words; all walks go on side by side, each to its last sampled place."""
    rows, n = windows.shape
    order, chosen, turns = _courses(n, repeats, places)
    padded = _own_blank(windows).ravel()
    start = np.arange(rows) * (n + 1)
    at, end = np.tile(start, (repeats, 1)), start + n
    key = np.repeat(mix(np.array([(part << 40) + s * 65_536 + size for s in order], np.uint64))[:, None], rows, axis=1)
    for step in range(turns.shape[1]):
        on = sum(places[-1] >= step for places in chosen)
        word = padded[at[:on]]
        for k in range(on):
            if step in chosen[k]:
                key[k] = mix(key[k] * _U(0x9E3779B97F4A7C15) + word[k])
        word *= turns[:on, step, 0][:, None]
        word += turns[:on, step, 1][:, None]
        word >>= _U(63)
        at[:on] += word.view(np.int64)
        np.minimum(at[:on], end, out=at[:on])
    out = np.empty_like(key)
    out[order] = key
    return out


def edits(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to a part of the stretch, where that part ends)."""
    row = np.zeros(len(stretch) + 1, np.int64)
    steps = np.arange(len(stretch) + 1)
    for i, word in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (stretch != word), row[1:] + 1)))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> _U(20)).astype(np.int64) & (slots - 1)


def _stretches(row: np.ndarray, at: np.ndarray, gap: int, width: int) -> np.ndarray:
    """The number of the stretch of each window: runs of neighbours of one row, cut where they get longer than ``width``."""
    new = np.append(True, (np.diff(at) > gap) | (np.diff(row) != 0))
    run = np.cumsum(new) - 1
    piece = (at - at[new][run]) // (width + 1)
    return np.cumsum(np.append(True, (np.diff(run) != 0) | (np.diff(piece) != 0))) - 1


def _padded(w: Words, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Windows of n words; blanks stand where a window goes beyond its row."""
    places = at[:, None] + np.arange(n)[None, :]
    inside = (places >= w.bounds[row][:, None]) & (places < w.bounds[row + 1][:, None])
    return np.where(inside, w.hashes[np.clip(places, 0, len(w.hashes) - 1)], _U(0))


class Screen:
    """What a task needs to find candidates: tables of fixed size of the items' word pairs and keys, and the items' sizes."""

    def __init__(self, mask: np.ndarray, known: np.ndarray, sizes: list[int], ratio: float, repeats: int, places: int):
        self.mask, self.known, self.sizes, self.ratio, self.repeats, self.places = mask, known, sizes, ratio, repeats, places

    def need(self, n: int) -> int:
        """Word pairs that n words within the allowed edits share with an item of n words (of one word: itself)."""
        return max(1, n - 1 - 2 * int(self.ratio * n))

    def _windows(self, w: Words, left: np.ndarray, row: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, first words) of the windows that hold enough of the pairs, which start at the places ``own``."""
        d, need = int(self.ratio * n), self.need(n)
        if n == 1:
            return row[own], own
        # a window with enough pairs has a first one, and the others within n words of it
        far = own[need - 1 :] - own[: len(own) - need + 1] <= n - 2
        first = own[: len(own) - need + 1][far]
        first = first[w.counts[row[first]] >= n - d]
        if not len(first):
            return first, first
        # it begins up to 2d words before that; it may stand over its row's ends by as many words as a passage may lack
        # there. All beginnings of a row are a span of counters, of which each first pair covers a part
        rows, k = np.unique(row[first], return_inverse=True)
        base = np.concatenate(([0], np.cumsum(w.counts[rows] - n + 2 * d + 1)))
        begin = first - w.bounds[rows[k]]
        low, high = np.maximum(begin - 2 * d, -d), np.minimum(begin, w.counts[rows[k]] - n + d)
        some = low <= high
        here = base[k] + d
        covered = np.bincount((here + low)[some], minlength=base[-1] + 1) - np.bincount((here + high + 1)[some], minlength=base[-1] + 1)
        place = np.flatnonzero(np.cumsum(covered) > 0)
        k = np.searchsorted(base, place, "right") - 1
        own_row, at = rows[k], place - base[k] - d + w.bounds[rows[k]]
        # pairs of the window that lie in its own row
        lo, hi = np.maximum(at, w.bounds[own_row]), np.minimum(at + n, w.bounds[own_row + 1]) - 1
        enough = np.searchsorted(own, hi, "left") - np.searchsorted(own, lo, "left") >= need
        return own_row[enough], at[enough]

    def _distinct(self, w: Words, own_row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of windows without those whose words came before, for each window its place among them)."""
        every = np.arange(len(at))
        if len(at) <= 4 * BLOCK:
            return every, every
        inside = (at >= w.bounds[own_row]) & (at + n <= w.bounds[own_row + 1])
        same = np.where(inside, rolling(w.hashes, n)[np.clip(at, 0, max(0, len(w.hashes) - n))] if len(w.hashes) >= n else _U(0), mix(every.astype(np.uint64)))
        _, first, back = np.unique(same, return_index=True, return_inverse=True)
        return first, back

    def candidates(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(key, item size, row, first word in the row, words) of the stretches that have a key of an item."""
        w = Words(texts, lower=True)
        if not self.sizes or not len(w.starts):
            return
        slots, left, row = len(self.mask), w.left(), w.row()
        hit = np.append(self.mask[_slot(rolling(w.hashes, 2), slots)], _U(0))[: len(w.hashes)] * (left > 1)
        dense = np.flatnonzero(hit != 0)
        dense_hit = hit[dense]
        for n in self.sizes:
            if n == 1:
                own = np.flatnonzero(self.mask[_slot(mix(w.hashes), slots)] & _U(2))
            else:
                own = dense[(dense_hit & _U(1 << (n % CLASSES))) != 0]
            if len(own) < self.need(n):
                continue
            own_row, at = self._windows(w, left, row, own, n)
            if not len(at):
                continue
            # neighbouring windows are one stretch, reported once for each of their keys
            group = _stretches(own_row, at, max(1, n // 3), n)
            begin = np.flatnonzero(np.append(True, np.diff(group) != 0))
            # a window that holds enough pairs is so many words off its passage at most
            last, off = np.append(begin[1:], len(at)) - 1, 2 * int(self.ratio * n) + 1
            # windows of equal words have equal keys: repetitive texts have few of them
            chosen, back = self._distinct(w, own_row, at, n)
            own_keys: dict[int, list[int]] = {}
            for k in range(0, len(chosen), BLOCK):
                block = chosen[k : k + BLOCK]
                found = keys(_padded(w, own_row[block], at[block], n), self.repeats, self.places)
                r, j = np.nonzero(self.known[_slot(found, len(self.known))])
                for window, key in zip((k + j).tolist(), found[r, j].view(np.int64).tolist(), strict=True):
                    own_keys.setdefault(window, []).append(key)
            if not own_keys:
                continue
            hit_windows = np.flatnonzero(np.isin(back, np.fromiter(own_keys, np.int64)))
            row_now, seen = -1, set()
            for g in np.unique(group[hit_windows]).tolist():
                i = int(own_row[begin[g]])
                a, b = max(int(w.bounds[i]), int(at[begin[g]]) - off), min(int(w.bounds[i + 1]), int(at[last[g]]) + n + off)
                words = w.hashes[a:b].tobytes()
                if i != row_now:
                    row_now, seen = i, set()
                # of equal stretches of a row the first is the one that is reported
                own_id = hashlib.blake2b(words, digest_size=16).digest()
                inside = hit_windows[np.searchsorted(hit_windows, begin[g]) : np.searchsorted(hit_windows, last[g], "right")]
                for key in sorted({key for x in np.unique(back[inside]).tolist() for key in own_keys[x]}):
                    if (own_id, key) not in seen:
                        seen.add((own_id, key))
                        yield key, n, i, a - int(w.bounds[i]), words


def _item_pairs(words: np.ndarray) -> list[int]:
    return (rolling(words, 2) if len(words) > 1 else mix(words)).view(np.int64).tolist()


def prepare(benchmark: DataFrame, *, item_column: str, text_column: str, repeats: int, places: int) -> DataFrame:
    """(item_id, n, words, keys, pairs): hashes of the words, walks and word pairs of each item that has a word."""
    items = textops.keyed(benchmark, {"item_id": item_column, "text": text_column}).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            w = Words(batch.column(1), lower=True)
            ids, out = batch.column(0).to_pylist(), []
            for n in sorted({int(c) for c in w.counts if c}):
                chosen = np.flatnonzero(w.counts == n)
                words = w.hashes[w.bounds[chosen][:, None] + np.arange(n)[None, :]]
                found = keys(words, repeats, places).view(np.int64)
                out += [(ids[i], n, words[k].tobytes(), found[:, k].tolist(), _item_pairs(words[k])) for k, i in enumerate(chosen)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "n", "words", "keys", "pairs"])

    return textops.cut(items.mapInArrow(textops.releasing(run), "item_id long, n long, words binary, keys array<long>, pairs array<long>"))


def _table_size(wanted: int, most: int) -> int:
    size = LEAST
    while size < min(wanted, most):
        size *= 2
    return size


def find(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", ratio: float = 0.2, repeats: int = 16, places: int = 2,
) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word): one row for each document and item that it contains."""
    docs = textops.keyed(docs, {"doc_id": id_column, "text": text_column}).withColumn("doc_id", F.col("doc_id").cast("long"))
    prepared = prepare(benchmark, item_column=item_column, text_column=item_text_column, repeats=repeats, places=places)
    total = prepared.agg(F.sum(F.size("pairs")), F.sum(F.size("keys"))).first()
    pair_slots, key_slots = (_table_size(8 * (n or 0), most) for n, most in zip(total, (MOST_PAIRS, MOST_KEYS), strict=True))
    slot_of = lambda c, slots: F.shiftrightunsigned(c, 20).bitwiseAND(F.lit(slots - 1)).alias("slot")
    # as many rows of a few numbers as the tables have places at most, whatever the benchmark's size
    masks = prepared.select(F.explode("pairs").alias("pair"), F.expr(f"shiftleft(1L, int(n % {CLASSES}))").alias("bit"))
    masks = masks.groupBy(slot_of("pair", pair_slots)).agg(F.bit_or("bit").alias("mask")).toArrow()
    marked = prepared.select(F.explode("keys").alias("key")).select(slot_of("key", key_slots)).distinct().toArrow()
    sizes = sorted(r["n"] for r in prepared.select("n").distinct().collect())  # one for each length of an item
    mask = np.zeros(pair_slots, np.uint64)
    mask[masks.column(0).to_numpy()] = masks.column(1).to_numpy().view(np.uint64)
    known = np.zeros(key_slots, bool)
    known[marked.column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(Screen(mask, known, sizes, ratio, repeats, places))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list) -> pa.RecordBatch:
            columns, kinds = list(zip(*found, strict=True)) or [[]] * 5, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "n", "doc_id", "at", "stretch"])

        for batch in batches:
            for part in textops.slices(batch, 1, 4 << 20):
                ids, found, size = part.column(0), [], 0
                for key, n, i, at, words in shared.value.candidates(part.column(1)):
                    found.append((key, n, ids[i].as_py(), at, words))
                    size += len(words)
                    if size > 4 << 20:
                        yield packed(found)
                        found, size = [], 0
                yield packed(found)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, words, at, stretch in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                own = np.frombuffer(words, np.uint64)
                distance, end = edits(own, np.frombuffer(stretch, np.uint64))
                if distance <= int(ratio * len(own)):
                    out.append((doc, item, distance, len(own), at + end))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "item_words", "end_word"])

    by_key = prepared.select("item_id", "n", "words", F.explode("keys").alias("key"))
    found = docs.where("text IS NOT NULL").mapInArrow(textops.releasing(candidates), "key long, n long, doc_id long, at long, stretch binary")
    pairs = found.join(by_key, ["key", "n"]).select("doc_id", "item_id", "words", "at", "stretch").distinct()
    return (
        pairs.mapInArrow(textops.releasing(verify), "doc_id long, item_id long, distance long, item_words long, end_word long")
        .groupBy("doc_id", "item_id")
        .agg(F.min(F.struct("distance", "end_word", "item_words")).alias("best"))
        .select("doc_id", "item_id", "best.distance", "best.item_words", "best.end_word")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of documents without any item; all columns stay. Rows with a null id stay."""
    return textops.without_ids(docs, id_column, find(docs, benchmark, id_column=id_column, **options).select("doc_id"))
