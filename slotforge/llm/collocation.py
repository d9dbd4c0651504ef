"""Phrase collocation mining by weighted acyclic automata (operator 11).

Texts are split into pieces at punctuation and line ends, and those into words. A phrase of two to five words that
occurs ``least`` times or more in its language is a candidate; it is scored by its weakest cut in two, as the count of
the phrase times all words of the language over the product of its parts' counts.

1. Filters: a phrase is frequent only if its words, and the phrases in it, are. Counts of hashes, in passes over the
   texts, leave bitmaps of at most 32 MB of what may be frequent; where frequent phrases outgrow them, they let more
   pass, and what follows is exact without them. Words count only if a frequent phrase has them.
2. Shards: each task counts the phrases that may be frequent, sorts them and builds, one by one, count transducers: for
   each first word an automaton over words whose outputs, added up along a path, are the phrase's count. Equal ends are
   shared.
3. Union: transducers are dealt by range of language and first word, their weights are summed, first in ``SALTS`` parts
   of each prefix, so that the most common words are split, and what is too rare is left out.
4. Composition: a candidate's first part begins like the candidate, and is looked up where it lies; the other part is
   sent to the transducer of its own first word, the hot ones dealt in several copies.

Filters tell by 48 bits of a hash, so more than the frequent phrases pass; what passes is counted as itself, and equal
phrases of a slice of text are found by two hashes of 64 bits.

Cases: A-Z count as lower case; null texts are empty; a null language is ``und``; rows with equal ids and repeated rows
count as often as they occur; ties of score and count go by the phrase's UTF-8 bytes; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.textops import Words, mix

_U = np.uint64
LONGEST, SALTS = 5, 16
#: Text that is hashed at a time: a slice takes some fifty times as much memory.
SLICE = 1 << 20
#: Lookups of one prefix that one copy of its transducer answers; entries of a task's counters before it writes them.
LOOKUPS, HELD = 5_000, 300_000
#: Bits of keys of phrases in filters, and where the second place begins; entries of a task's counts of keys before it writes them; text of a shard of them.
KEY_BITS, SECOND, FLUSH, SHARD_BYTES = 48, 20, 1_000_000, 8 << 20
NEEDED = np.uint64(0xD6E8FEB86659FD93)
_BREAK, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b" \t"]] = True
_STEP = _U(0x9E3779B97F4A7C15)


class Pieces(Words):
    """Words of the texts of one column, and for each the words from it to the end of its piece, itself included."""

    def __init__(self, column: pa.Array, langs: list[str]):
        super().__init__(column, lower=True, space=_BREAK | _GAP)
        breaks, row = np.concatenate(([0], np.cumsum(_BREAK[self.data])))[self.starts], self.row()
        last = np.append((row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1]), True)[: len(row)]
        ends = np.flatnonzero(last)
        self.room = np.repeat(ends + 1, np.diff(ends, prepend=-1)) - np.arange(len(row))
        known = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
        self.langs = np.repeat(np.array([known[lang] for lang in langs], np.uint64), self.counts)
        self.made: dict[int, np.ndarray] = {}

    def keys(self, size: int) -> np.ndarray:
        """A hash of language and phrase of ``size`` words at each word; those that leave the piece are meaningless."""
        if size not in self.made:
            out = mix(self.hashes + _U(size)) ^ self.langs
            for k in range(1, size):
                out[:-k] = out[:-k] * _STEP + self.hashes[k:]
                out[:-k] ^= out[:-k] >> _U(29)
            self.made[size] = mix(out)
        return self.made[size]

    def needed(self) -> np.ndarray:
        """Keys that tell of each word that it is in a frequent phrase."""
        return mix(self.keys(1) + NEEDED)

    def groups(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first places, numbers) of the equal phrases of ``size`` words among those at the given places.

        Equal keys are checked by a second hash of their words.
        """
        key, row = self.keys(size)[at], mix(self.langs[at])
        other = sum((mix(self.hashes[at + k] ^ _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for k in range(size)), row)
        _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if (other != other[first][back]).any():
            _, first, n = np.unique(np.stack((key, other), axis=1), axis=0, return_index=True, return_counts=True)
        return at[first], n


class Filter(textops.IdBits):
    """Which keys may be of frequent phrases: two bits tell, so that few others pass."""

    def __init__(self, keys: DataFrame):
        super().__init__(keys.select(F.explode(F.array("key", F.shiftright("key", SECOND))).alias("key")), each=64)

    def slot(self, ids):
        return F.pmod(ids, F.lit(self.size)) + 1

    def may(self, keys: np.ndarray) -> np.ndarray:
        place = lambda k: self.has((k & _U(self.size - 1)).astype(np.int64) + 1)
        return place(keys) & place(keys >> _U(SECOND))


def _possible(pieces: Pieces, size: int, filters: dict[int, Filter]) -> np.ndarray:
    """The words at which a phrase of ``size`` words begins that may be frequent, as far as the filters tell."""
    at = np.flatnonzero(pieces.room >= size)
    for own in sorted(f for f in filters if f <= size):
        for k in range(size - own + 1):
            at = at[filters[own].may(pieces.keys(own)[at + k])]
    return at


def _encoded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as steps of four bytes (eight where one is too wide), counts as one byte with the large ones behind."""
    steps = np.diff(keys, prepend=_U(0))
    wide = len(steps) and int(steps.max()) >= 1 << 32
    small = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(keys), wide], np.int64)
    return head.tobytes() + steps.astype(np.uint64 if wide else np.uint32).tobytes() + small.tobytes() + counts[small == 255].astype(np.int64).tobytes()


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, wide = np.frombuffer(data, np.int64, 2).tolist()
    kind = np.dtype(np.uint64 if wide else np.uint32)
    at = 16 + size * kind.itemsize
    small = np.frombuffer(data, np.uint8, size, at)
    counts = small.astype(np.int64)
    counts[small == 255] = np.frombuffer(data[at + size :], np.int64)
    return np.cumsum(np.frombuffer(data, kind, size, 16).astype(np.uint64)), counts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def _filter(docs: DataFrame, sizes: tuple[int, ...], filters: dict[int, Filter], least: int, shards: int) -> Filter:
    """Keys of the phrases of these sizes that occur ``least`` times or more.

    Where frequent pairs are known, the words in them pass as well, under keys of their own (``NEEDED``). Each task's
    counts are dealt by key to ``shards``, packed; two phrases of one key (of 48 bits) only let more pass.
    """
    bits = KEY_BITS - shards.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, n = _summed([k & _U((1 << KEY_BITS) - 1) for k in keys], counts)
            shard = (key >> _U(bits)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
            for first in range(0, len(cuts) - 1, 4096):
                part = cuts[first : first + 4097]
                packed = [_encoded(key[a:b] & _U((1 << bits) - 1), n[a:b]) for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[part[:-1]]), pa.array(packed, pa.binary())], ["shard", "data"])

        for batch in batches:
            for part in textops.slices(batch, 1, SLICE):
                pieces = Pieces(part.column(1), part.column(0).to_pylist())
                for size in sizes:
                    key, n = np.unique(pieces.keys(size)[_possible(pieces, size, filters)], return_counts=True)
                    keys.append(key)
                    counts.append(n)
                if 2 in filters:
                    pairs = _possible(pieces, 2, filters)
                    key = np.unique(pieces.needed()[np.concatenate((pairs, pairs + 1))])
                    keys.append(key)
                    counts.append(np.full(len(key), least))
                held = sum(map(len, keys))
            if held > FLUSH:
                yield from out()
                keys, counts, held = [], [], 0
        if keys:
            yield from out()

    def total(table: pa.Table) -> pa.Table:
        key, n = _summed(*zip(*[_decoded(x) for x in table.column("data").to_pylist()], strict=True))
        key = key[n >= least] | _U(table.column("shard")[0].as_py()) << _U(bits)
        return pa.table({"key": pa.array(key.view(np.int64), pa.int64())})

    counted = docs.mapInArrow(textops.releasing(run), "shard long, data binary").groupBy("shard").applyInArrow(total, "key long")
    return Filter(textops.cut(counted))


class Transducer:
    """An acyclic automaton over words whose outputs add up to a phrase's count; built from phrases in ascending order.

    States are numbered as they become final; equal ones are one. A state is (count of the phrase that ends there beyond
    what its path has, or -1; arcs), an arc (word, output, state). Outputs lie as near to the beginning as they can.
    """

    def __init__(self):
        self.states: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.path: list[list] = [[-1, []]]
        self.last: tuple = ()

    def add(self, words: tuple, count: int) -> None:
        shared = next((k for k, (a, b) in enumerate(zip(words, self.last, strict=False)) if a != b), min(len(words), len(self.last)))
        self._settle(shared)
        for depth in range(shared):
            arc, node = self.path[depth][1][-1], self.path[depth + 1]
            common = min(arc[1], count)
            rest = arc[1] - common
            if rest:  # what the new phrase does not have moves one arc on
                arc[1] = common
                node[0] += rest if node[0] >= 0 else 0
                for on in node[1]:
                    on[1] += rest
            count -= common
        for depth in range(shared, len(words)):
            self.path[depth][1].append([words[depth], count, None])
            self.path.append([-1, []])
            count = 0
        self.path[len(words)][0] = count
        self.last = words

    def _settle(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            final, arcs = self.path.pop()
            state = (final, tuple(map(tuple, arcs)))
            if state not in self.known:
                self.known[state] = len(self.states)
                self.states.append(state)
            self.path[-1][1][-1][2] = self.known[state]

    def to_bytes(self) -> bytes:
        self._settle(0)
        final, arcs = self.path[0]
        states = [*self.states, (final, tuple(map(tuple, arcs)))]
        words = {w: k for k, w in enumerate(dict.fromkeys(w for _, arcs in states for w, _, _ in arcs))}
        flat = [len(states)]
        for final, arcs in states:
            flat += [final, len(arcs)]
            for word, output, state in arcs:
                flat += [words[word], output, state]
        return np.array(flat, np.int64).tobytes() + b" ".join(words)

    @staticmethod
    def of(counts: dict[tuple, int]) -> bytes:
        made = Transducer()
        for words in sorted(counts):
            made.add(words, counts[words])
        return made.to_bytes()


class Counts:
    """A transducer read back: a count by phrase, and all phrases in order."""

    def __init__(self, data: bytes):
        states = int(np.frombuffer(data, np.int64, 1)[0])
        head, at = memoryview(data).cast("B"), 8
        raw = []
        for _ in range(states):
            final, arcs = np.frombuffer(head, np.int64, 2, at).tolist()
            raw.append((final, np.frombuffer(head, np.int64, 3 * arcs, at + 16).tolist()))
            at += 16 + 24 * arcs
        words = bytes(head[at:]).split(b" ")
        self.states = [(final, {words[a[k]]: (a[k + 1], a[k + 2]) for k in range(0, len(a), 3)}) for final, a in raw]

    def get(self, words: Iterable[bytes]) -> int | None:
        state, total = len(self.states) - 1, 0
        for word in words:
            arc = self.states[state][1].get(word)
            if arc is None:
                return None
            total, state = total + arc[0], arc[1]
        final = self.states[state][0]
        return total + final if final >= 0 else None

    def items(self) -> Iterator[tuple[tuple, int]]:
        todo = [((), len(self.states) - 1, 0)]
        while todo:
            words, state, total = todo.pop()
            final, arcs = self.states[state]
            if final >= 0:
                yield words, total + final
            todo += [((*words, w), to, total + output) for w, (output, to) in reversed(arcs.items())]


SHARD = "lang string, prefix binary, data binary, words long"


def _by_prefix(lang: str, counts: dict[tuple, int]) -> Iterator[tuple]:
    """(lang, first word, transducer, 0) of phrases."""
    grouped: dict[bytes, dict] = {}
    for words, n in counts.items():
        grouped.setdefault(words[0], {})[words] = n
    for prefix in sorted(grouped):
        yield lang, prefix, Transducer.of(grouped[prefix]), 0


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["lang", "prefix", "data", "words"])


def _count(pieces: Pieces, langs: list[str], filters: dict[int, Filter], held: dict[str, Counter], longest: int) -> None:
    """Adds the phrases of a slice that may be frequent."""
    row, text = pieces.row(), pieces.data.tobytes().lower()
    starts, ends = pieces.starts.tolist(), pieces.ends.tolist()
    for size in range(1, longest + 1):
        at = np.flatnonzero(filters[max(filters)].may(pieces.needed())) if size == 1 else _possible(pieces, size, filters)
        first, n = pieces.groups(size, at)
        for k, times in zip(first.tolist(), n.tolist(), strict=True):
            words = tuple([text[a:b] for a, b in zip(starts[k : k + size], ends[k : k + size], strict=True)])
            held[langs[row[k]]][words] += times


def shards(docs: DataFrame, filters: dict[int, Filter], longest: int) -> DataFrame:
    """Transducers of each task's phrases by language and first word; rows without a prefix have numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        total: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = [(lang, None, None, n) for lang, n in total.items()]
            for lang in sorted(held):
                for row in _by_prefix(lang, held[lang]):
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield _shard_rows(rows)
                        rows = []
            yield _shard_rows(rows)

        for batch in batches:
            for part in textops.slices(batch, 1, SLICE):
                langs = part.column(0).to_pylist()
                for lang in langs:
                    held.setdefault(lang, Counter())
                pieces = Pieces(part.column(1), langs)
                for lang, n in zip(langs, pieces.counts.tolist(), strict=True):
                    total[lang] += n
                _count(pieces, langs, filters, held, longest)
                if sum(map(len, held.values())) > HELD:
                    yield from out()
                    held, total = {}, Counter()
        yield from out()

    return docs.mapInArrow(textops.releasing(run), SHARD)


def _union(rows: DataFrame, names: list[str], least: int) -> DataFrame:
    """Transducers with equal ``names`` as one, weights summed; phrases below ``least`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, Counter()

        def out() -> list[tuple]:
            kept = {w: n for w, n in counts.items() if n >= least}
            return [(key[0], key[1], Transducer.of(kept), 0)] if key and kept else []

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for *own, data in zip(*columns, strict=True):
                if own != key:
                    done += out()
                    key, counts = own, Counter()
                for words, n in Counts(data).items():
                    counts[words] += n
            yield _shard_rows(done)
        yield _shard_rows(out())

    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names).select(*names, "data")
    return dealt.mapInArrow(textops.releasing(run), SHARD)


CUTS = "lang string, words array<binary>, size int, a long, k int, l long, r long"


def _candidates(unions: DataFrame) -> DataFrame:
    """Each cut of each candidate: (lang, words, a, k, l) with the first word of the part to look up."""
    schema = "lang string, prefix binary, words array<binary>, a long, k int, l long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("words", pa.list_(pa.binary())), ("a", pa.int64()), ("k", pa.int32()), ("l", pa.int64())])
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, rows = Counts(data), []
                for words, n in own.items():
                    rows += [(lang, words[k], words, n, k, own.get(words[:k])) for k in range(1, len(words))]
                for at in range(0, len(rows), 5000):
                    columns = list(zip(*rows[at : at + 5000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return unions.select("lang", "data").mapInArrow(textops.releasing(run), schema)


def _composed(unions: DataFrame, asked: DataFrame) -> DataFrame:
    """CUTS: the other part's count of each cut, from the transducer of its first word."""
    copies = asked.groupBy("lang", "prefix").agg(F.ceil(F.count("*") / LOOKUPS).cast("int").alias("copies"))
    copies = textops.cut(copies)
    theirs = unions.select("lang", "prefix", "data").join(copies, ["lang", "prefix"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mine = asked.join(copies, ["lang", "prefix"]).withColumn("copy", F.pmod(F.xxhash64("words", "k"), "copies").cast("int"))
    columns = ["lang", "prefix", "copy", "data", "words", "a", "k", "l"]
    rows = theirs.select("lang", "prefix", "copy", "data", *[F.lit(None).cast(t).alias(c) for c, t in (("words", "array<binary>"), ("a", "long"), ("k", "int"), ("l", "long"))])
    rows = rows.unionByName(mine.withColumn("data", F.lit(None).cast("binary")).select(columns))
    rows = rows.repartition("lang", "prefix", "copy").sortWithinPartitions("lang", "prefix", "copy", F.col("data").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        kinds = [pa.string(), pa.list_(pa.binary()), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for lang, _, _, data, words, a, k, left in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if data is not None:
                    own = Counts(data)
                else:
                    out.append((lang, words, len(words), a, k, left, own.get(words[k:])))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "words", "size", "a", "k", "l", "r"])

    return rows.mapInArrow(textops.releasing(run), CUTS)


def counts(docs: DataFrame, *, least: int = 100, longest: int = LONGEST, lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(transducers, words): a transducer of the frequent phrases by language and first word; each language's words."""
    docs = textops.keyed(docs, {"lang": lang_column, "text": text_column}).withColumn("lang", F.coalesce("lang", F.lit("und")))
    filters: dict[int, Filter] = {}
    dealt = max(256, 1 << ((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES).bit_length())
    for sizes in [(1,), (2,), tuple(range(3, max(4, longest)))]:
        filters |= dict.fromkeys(sizes, _filter(docs, sizes, filters, least, dealt))
    rows = textops.cut(shards(docs, filters, longest))
    words = rows.where("prefix IS NULL").groupBy("lang").agg(F.sum("words").alias("n"))
    salted = rows.where("prefix IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(SALTS)))
    partial = textops.cut(_union(salted, ["lang", "prefix", "salt"], 1))
    return textops.cut(_union(partial, ["lang", "prefix"], least)), words


def scored(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, words, cut): the lowest-scoring cut of each phrase; products have up to 38 digits."""
    wide = "cast({} AS decimal(19,0))"
    score = F.expr(f"1000 * cast(n AS decimal(15,0)) * {wide.format('a')} DIV ({wide.format('l')} * {wide.format('r')})")
    return cuts.join(words, "lang").withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))


def mine(docs: DataFrame, *, least: int = 100, top: int = 2000, **options) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and text."""
    unions, words = counts(docs, least=least, **options)
    cuts = textops.cut(_composed(unions, _candidates(unions)))
    # a longer phrase that occurs as often as one in it: then one with a single word more does, too
    whole = cuts.where("a = l AND k = size - 1 AND k > 1").select("lang", F.slice("words", F.lit(1), F.col("k")).alias("words"))
    whole = whole.unionByName(cuts.where("a = r AND k = 1 AND size > 2").select("lang", F.slice("words", F.lit(2), F.col("size") - 1).alias("words"))).distinct()
    weakest = scored(cuts, words)
    left = weakest.join(whole, ["lang", "words"], "left_anti")
    phrase = F.concat_ws(" ", F.transform("words", lambda w: F.decode(w, "UTF-8")))
    ranked = left.select("lang", phrase.alias("phrase"), "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
