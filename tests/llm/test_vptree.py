import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from slotforge.llm import vptree

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text):
    words = (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, within=3):
    """(id, fingerprint) to the least id reachable."""
    parent = {d: d for d, _ in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(nodes):
        for b, g in nodes[:i]:
            if (f ^ g).bit_count() <= within:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: find(d) for d, _ in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB é\tZ\n日 "), max_size=60))
def test_fingerprint(text):
    assert vptree.fingerprint(text.encode()) == plain(text)


@pytest.mark.parametrize("block", [1, 7, 50])
def test_blocks_of_a_long_text(monkeypatch, block):
    monkeypatch.setattr(vptree, "BLOCK_BYTES", block)
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 200):
        text = " \n".join(f"w{rng.randrange(50)}" * rng.randrange(1, 5) for _ in range(n))
        assert vptree.fingerprint(text.encode()) == plain(text)


def test_brute_force(spark, docs, corpus):
    got = sorted((tuple(r) for r in vptree.components(docs).collect()), key=str)
    of = classes([(r[0], plain(r[1])) for r in corpus if r[0] is not None])
    assert got == sorted(((r[0], f"{plain(r[1]):016x}", None if r[0] is None else of[r[0]]) for r in corpus), key=str)


def spread(seed, singles, families, size):
    """Unlike fingerprints, families of chains of near ones, and pairs at distances 3 and 4."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(singles)]
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    for _ in range(families):
        own = [rng.getrandbits(64)]
        for _ in range(size):
            own.append(flip(rng.choice(own), rng.randrange(1, 6)))
        fps += own
    fps += [flip(f, n) for f in fps[: singles // 2] for n in (3, 4)]
    return [(i, f) for i, f in enumerate(dict.fromkeys(fps))]


@pytest.mark.parametrize("options", [{"part": 8, "asked": 16}, {"part": 40, "asked": 10_000, "sample": 60}, {}])
def test_links_join_what_is_near(spark, options):
    nodes = spread(5, 200, 4, 60)
    random.Random(6).shuffle(nodes)
    frame = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), d) for d, f in nodes], "fp long, doc_id long")
    found = [tuple(r) for r in vptree.links(frame, **options).collect()]
    of = dict(nodes)
    assert all((of[x] ^ of[y]).bit_count() <= 3 for x, y in found)
    parent = {d: d for d in of}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in found:
        p, q = sorted((find(x), find(y)))
        parent[q] = p
    assert {d: find(d) for d in of} == classes(nodes)


def test_no_pair_is_lost_by_routing():
    nodes = np.array([f for _, f in spread(7, 400, 3, 50)], np.uint64)
    tree = vptree.Tree(nodes[::3], 32)
    rows, shard, home = tree.route(nodes, 3)
    assert sorted(rows[home]) == list(range(len(nodes)))
    where = dict(zip(rows[home], shard[home], strict=True))
    asked = set(zip(rows[~home], shard[~home], strict=True))
    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes ^ nodes[i]) <= 3):
            assert where[i] == where[j] or (i, where[j]) in asked or (j, where[i]) in asked
    assert len(asked) < 0.8 * 31 * len(nodes) and tree.depth == 5


def test_a_dense_family_reports_few_links(spark):
    center, rng = random.Random(8).getrandbits(64), random.Random(9)
    fps = list({center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(1500)})
    frame = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    found = vptree.links(frame, part=64).count()
    assert len(fps) - 1 <= found < 8 * len(fps)


def test_clashing_columns_and_empty_table(spark, nothing):
    rows = [(1, "one two three", "a", 5, "h"), (2, "ONE two three", "b", 6, "i"), (3, None, "c", 7, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int, component string")
    assert sorted(tuple(r) for r in vptree.components(docs).collect()) == [(1, f"{plain('one two three'):016x}", 1), (2, f"{plain('one two three'):016x}", 1), (3, "0" * 16, 3)]
    assert vptree.components(nothing).collect() == []
