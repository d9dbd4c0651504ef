import random

import numpy as np
import pytest
from slotforge.llm import decontam


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_matches_the_textbook():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert decontam.edits(np.array(a, np.uint64), np.array(b, np.uint64))[0] == distance(a, b)


def test_walk_of_equal_words_is_equal_and_near_words_stay_near():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, 40).astype(np.uint64)
    b = np.delete(a, 5)
    b = np.append(b, np.uint64(7))
    x, y, z = decontam.walk(np.stack([a, b, rng.integers(1, 2**63, 40).astype(np.uint64)]), 1)
    assert (x == decontam.walk(a[None, :], 1)[0]).all()
    assert (x == y).mean() > 0.3 > (x == z).mean()


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(900)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b"), (94, "solo"), (95, "x1 x2 x3 x4"), (93, items_twice := "q w e r t y u i")]
    docs, n = [], 0
    for _ in range(300):
        item, text = rng.choice(items[:40])
        words = text.split()
        for _ in range(rng.randrange(0, int(0.2 * len(words)) + 3)):
            at = rng.randrange(len(words))
            kind = rng.randrange(3)
            words[at : at + (kind != 1)] = [] if kind == 0 else [word()]
        around = [[word() for _ in range(rng.randrange(0, 60))] for _ in range(2)]
        docs.append((n, " ".join(around[0] + words + around[1])))
        n += 1
    docs += [(n + i, " ".join(word() for _ in range(200))) for i in range(60)] + [(2000, None), (2001, ""), (2002, items_twice.upper()), (None, items_twice), (2003, "A b"), (2002, items_twice), (2004, "then SOLO ends"), (2005, "b a x1 x2 x3 x4 y"), (2006, "x1 x2 x4")]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_recall_and_exactness_against_brute_force(planted):
    df, benchmark, docs, items = planted
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.find(df, benchmark).collect()}
    want = {}
    for doc, text in docs:
        for item, own in items:
            a, b = (own or "").lower().split(), (text or "").lower().split()
            if a and (d := distance(a, b)) <= int(0.2 * len(a)):
                want[doc, item] = min(d, want.get((doc, item), d))
    assert set(found) <= set(want)
    assert all(found[k] >= want[k] for k in found)
    assert len(found) >= 0.9 * len(want) > 100
    close = {k for k, d in want.items() if d <= 0.1 * len(dict(items)[k[1]].split())}
    assert len(close & set(found)) >= 0.97 * len(close)


def test_dropping_keeps_clean_rows_and_columns(planted):
    df, benchmark, docs, _ = planted
    bad = {r.doc_id for r in decontam.find(df, benchmark).collect() if r.doc_id is not None}
    left = decontam.drop_contaminated(df, benchmark)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_empty_tables(planted):
    df, benchmark, _, _ = planted
    assert decontam.find(df.limit(0), benchmark).count() == 0
    assert decontam.find(df, benchmark.limit(0)).count() == 0


def test_edited_items_beside_exact_ones_are_found(spark):
    """Lists of leaked items of one size, in one document and over the ends of neighbouring rows."""
    rng = random.Random(7)
    words = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, words(40)) for i in range(80)]

    def edited(item):
        out = list(item)
        for at in rng.sample(range(40), 4):
            out[at] = words(1)[0]
        return out

    docs, want = [], set()
    for i in range(0, 80, 2):
        a, b = items[i][1], items[i + 1][1]
        docs.append((i, " ".join(words(9) + edited(a) + b + edited(a) + words(9))))
        docs += [(1000 + i, " ".join(words(9) + edited(a))), (2000 + i, " ".join(b + words(9)))]
        want |= {(i, i), (i, i + 1), (1000 + i, i), (2000 + i, i + 1)}
    docs.append((5000, " ".join(" ".join(edited(x)) for _, x in items)))
    want |= {(5000, i) for i, _ in items}
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.item_id) for r in decontam.find(df, spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")).collect()}
    assert found <= want
    for low, high in ((0, 1000), (1000, 2000), (5000, 6000)):
        part = {k for k in want if low <= k[0] < high}
        assert len(part & found) >= 0.97 * len(part)


def test_documents_that_are_items_cut_short_are_found(spark):
    """The whole text is an item without its last, its first or some middle words: fewer words than the item."""
    rng = random.Random(11)
    items = [(i, [f"t{rng.randrange(5000)}" for _ in range(rng.randrange(5, 60))]) for i in range(60)]
    docs, want = [], set()
    for i, item in items:
        n, most = len(item), int(0.2 * len(item))
        middle = set(rng.sample(range(1, n - 1), max(1, most // 2)))
        cuts = [item[:-1], item[: n - most], item[1:], item[most:], [x for k, x in enumerate(item) if k not in middle], item[: n - most - 1]]
        for k, words in enumerate(cuts):
            docs.append((i * 10 + k, " ".join(words)))
            if distance(item, words) <= most:
                want.add((i * 10 + k, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.item_id) for r in decontam.find(df, spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")).collect()}
    assert found <= want
    for k in range(5):
        part = {x for x in want if x[0] % 10 == k}
        assert len(part) > 50
        assert len(part & found) >= 0.9 * len(part), k


def test_keys_are_sampled_places_of_the_walks():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 23, 60):
        rows = rng.integers(1, 2**63, (7, n)).astype(np.uint64)
        rows[3] = rows[0]
        got = decontam.keys(rows, 6, 2)
        for seed in range(6):
            places = decontam.walk(rows, seed)[:, decontam.sampled(n, seed, 2)]
            same = (places[:, None, :] == places[None, :, :]).all(2)
            assert (same == (got[seed][:, None] == got[seed][None, :])).all() and same[0, 3]


def test_no_key_is_common_among_other_windows():
    """Past their ends walks share nothing: a key that many windows have would pair them with all items of its size."""
    rng = np.random.default_rng(1)
    for n in (1, 3, 8, 15, 40, 59):
        found = decontam.keys(rng.integers(1, 2**63, (3000, n)).astype(np.uint64), 16, 2)
        assert all(np.unique(k, return_counts=True)[1].max() <= 2 for k in found)


def test_a_very_long_text_and_clashing_columns(spark):
    rng = random.Random(2)
    words = [f"z{rng.randrange(3000)}" for _ in range(60_000)]
    items = [(i, " ".join(words[k : k + 30])) for i, k in enumerate((0, 20_000, 59_970))]
    df = spark.createDataFrame([(1, " ".join(words), 5, 6, 7, "q"), (2, "z1 z2", 5, 6, 7, "q")], "doc_id long, text string, key int, n int, at int, stretch string")
    benchmark = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, n int, keys int")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontam.find(df, benchmark).collect()} == {(1, i, 0) for i in range(3)}
    assert decontam.drop_contaminated(df, benchmark).collect() == [(2, "z1 z2", 5, 6, 7, "q")]


def altered(rng, item, edits):
    """The item after so many substitutions, deletions and insertions at places of their own."""
    out = [[w] for w in item]
    for at in rng.sample(range(len(item)), edits):
        out[at] = rng.choice([[f"new{rng.randrange(10**6)}"], [], [item[at], f"new{rng.randrange(10**6)}"]])
    return [w for part in out for w in part]


def test_recall_does_not_fall_with_the_size(spark):
    """At the stated ratio and at half of it, items of all sizes; other words stand around them."""
    rng = random.Random(21)
    items, docs, cells = [], [], {}
    for n in (6, 50, 65, 200, 500):
        for ratio in (0.1, 0.2):
            for _ in range(50):
                item = [f"t{rng.randrange(20_000)}" for _ in range(n)]
                around = [[f"a{rng.randrange(20_000)}" for _ in range(rng.randrange(80))] for _ in range(2)]
                docs.append((len(docs), " ".join(around[0] + altered(rng, item, int(ratio * n)) + around[1])))
                items.append((len(items), " ".join(item)))
                cells[len(items) - 1] = (n, ratio)
    found = {(r.doc_id, r.item_id) for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {cell: sum((i, i) in found for i, c in cells.items() if c == cell) / 50 for cell in set(cells.values())}
    assert min(recall.values()) >= 0.9, recall


def _screen(items, ratio=0.2):
    import pyarrow as pa
    from slotforge.llm.textops import Words

    mask, known = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
    for item in items:
        words = Words(pa.array([item]), lower=True).hashes
        n = len(words)
        mask[decontam._slot(np.array(decontam._item_pairs(words), np.int64).view(np.uint64), 1 << 20)] |= np.uint64(1 << (n % decontam.CLASSES))
        known[decontam._slot(decontam.keys(words[None, :], 16, 2).ravel(), 1 << 20)] = True
    return decontam.Screen(mask, known, sorted({len(i.split()) for i in items}), ratio, 16, 2)


@pytest.mark.parametrize("size,edited", [(300, False), (1000, False), (1000, True)])
def test_long_repetitive_texts_take_bounded_memory(size, edited):
    """4 MB of one item again and again, exact or with a word changed in each copy."""
    import time
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(2)
    item = [f"t{rng.randrange(90_000)}" for _ in range(size)]
    copies = (4 << 20) // len(" ".join(item))
    parts = [list(item) for _ in range(copies)]
    if edited:
        for part in parts[:60]:
            part[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
    text, screen = " ".join(w for part in parts for w in part), _screen([" ".join(item)])
    tracemalloc.start()
    start, found = time.process_time(), 0
    for _ in screen.candidates(pa.array([text])):
        found += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 500 << 20 and time.process_time() - start < 120


def test_a_repetitive_text_reports_its_first_copy(spark):
    rng = random.Random(4)
    item = [f"t{rng.randrange(90_000)}" for _ in range(30)]
    docs = spark.createDataFrame([(1, " ".join(["a", "b"] + item * 400)), (2, " ".join(item * 300 + ["end"]))], "doc_id long, text string")
    found = {r.doc_id: (r.distance, r.end_word) for r in decontam.find(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {1: (0, 32), 2: (0, 30)}


def test_tables_that_are_too_small_change_nothing(planted, monkeypatch):
    df, benchmark, _, _ = planted
    want = sorted(map(tuple, decontam.find(df, benchmark).collect()), key=str)
    for name in ("LEAST", "MOST_PAIRS", "MOST_KEYS"):
        monkeypatch.setattr(decontam, name, 64)
    assert sorted(map(tuple, decontam.find(df, benchmark).collect()), key=str) == want
