import random

import numpy as np
import pytest
from slotforge.llm import neardup


def shingles(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(rows, width, percent):
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_brute_force(docs, corpus, width, percent):
    found = neardup.components(docs, width=width, percent=percent)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(corpus, width, percent)


def near_copies(seed, groups, size):
    """Chains of copies, each with a few words changed from the one before, and passages shared by unlike texts."""
    rng = random.Random(seed)
    rows, n = [], 0
    shared = [f"s{i}" for i in range(60)]
    for _ in range(groups):
        words = [f"u{rng.randrange(100_000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(size):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(rng.randrange(0, 4)):
                words = list(words)
                words[rng.randrange(len(words))] = f"u{rng.randrange(100_000)}"
    for _ in range(40):
        rows.append((n, " ".join([f"u{rng.randrange(100_000)}" for _ in range(rng.randrange(1, 30))] + shared)))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [2 << 20, 10_000])
def test_chains_and_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE_BYTES", tile)
    monkeypatch.setattr(neardup, "TILE_ROWS", 2000 if tile > 1 << 20 else 7)
    rows = near_copies(4, 12, 15)
    found = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 3, 85)


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    pool = np.sort(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    for share in (0.5, 0.85, 0.95):
        both = int(2000 * share)
        a, b = np.sort(pool[:2000]), np.sort(np.concatenate((pool[:both], pool[2000 : 4000 - both])))
        true = both / (4000 - both)
        assert abs(float(neardup.estimate(neardup.registers(a), neardup.registers(b))) - true) < 0.12


def test_band_size_meets_the_miss_rate():
    for t in (0.8, 0.85, 0.9):
        r = neardup.band_size(t)
        assert (1 - t**r) ** (256 // r) <= 1e-5 < (1 - t ** (r + 1)) ** (256 // (r + 1))


def test_keep_one_keeps_all_columns(docs, corpus):
    left = neardup.keep_one(docs, width=3, percent=85)
    assert left.columns == docs.columns
    want = {d for d, _, _, kept in brute(corpus, 3, 85) if kept}
    assert {r.doc_id for r in left.collect()} == want


def test_components_of_links(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (20, 21), (22, 21), (23, 22), (24, 20), (6, 6)]
    found = dict(tuple(r) for r in neardup.connect(spark.createDataFrame(links, "x long, y long")).collect())
    want = {3: 2, 4: 2, 5: 2, 8: 7, 9: 7, 21: 20, 22: 20, 23: 20, 24: 20}
    assert {k: v for k, v in found.items() if k != v} == want


def test_empty_table(nothing):
    assert neardup.components(nothing).count() == 0
