import re
from collections import Counter

from slotforge.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_counts_match_brute_force(spark, docs, corpus):
    extra = ["a b c d e f a b c d e g a b c d e", "x\nx\n\n \n x\nx", "é# é# é# é# é# é#", "line one\nline one\nline two", "A!! B!! C!!"]
    rows = [(c[0], c[1]) for c in corpus] + [(1000 + i, t) for i, t in enumerate(extra)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == Counter((d, *brute(t)) for d, t in rows)
    assert all(r.kept is False for r in found if r.base_failed)


def plain_em(rows, rounds=500):
    """EM over documents one by one, in plain numbers, with the documented priors and start."""
    post = [(r.count("g") + 1) / (r.count("g") + r.count("b") + 2) for r in rows]
    for _ in range(rounds):
        share = (sum(post) + quality.PRIOR_SHARE[0]) / (len(rows) + sum(quality.PRIOR_SHARE))
        rates = []
        for own, (fails, passes) in ((post, quality.PRIOR_GOOD), ([1 - p for p in post], quality.PRIOR_BAD)):
            rates.append([])
            for k in range(len(rows[0])):
                bad = sum(p for p, r in zip(own, rows, strict=True) if r[k] == "b")
                cast = sum(p for p, r in zip(own, rows, strict=True) if r[k] != "-")
                rates[-1].append((bad + fails) / (cast + fails + passes))
        new = []
        for r in rows:
            like = [share, 1 - share]
            for c in (0, 1):
                for k, v in enumerate(r):
                    like[c] *= {"b": rates[c][k], "g": 1 - rates[c][k], "-": 1}[v]
            new.append(like[0] / sum(like))
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        post = new
        if moved < 1e-9:
            break
    return dict(zip(rows, post, strict=True))


COUNTS = {"ggggggggg": 800, "ggbggggbg": 40, "ggbggggbb": 30, "ggggbbbbg": 30, "gggbbggbg": 10, "gggbggggg": 6, "-gggggggg": 20, "gggg-gg-g": 9, "ggbgggggg": 1}


def test_em_is_the_plain_one():
    found, want = quality.fit(COUNTS), plain_em([p for p, n in COUNTS.items() for _ in range(n)])
    assert set(found) == set(want) and all(abs(found[p] - want[p]) < 1e-6 for p in want)


def test_rules_that_others_bear_out_weigh_more():
    found = quality.fit(COUNTS)
    assert all(found[p] > 0.5 for p in ("ggggggggg", "-gggggggg", "gggg-gg-g"))
    assert all(found[p] < 0.5 for p in ("ggbggggbg", "ggbggggbb", "ggggbbbbg", "gggbbggbg"))
    # one bad vote does not decide by itself: of a rule that errs alone it is forgiven, of one borne out it is not
    assert found["gggbggggg"] > 0.5 > found["ggbgggggg"]
    assert quality.fit({}) == {}


def test_posterior_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    every = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    found = every.join(spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label"), "doc_id")
    rows = [r for r in found.collect() if not r.base_failed]
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    alone = {r.kept for r in every.collect() if not r.base_failed and r.votes.count("b") == 1}
    assert True in alone  # not all rules must pass


def test_empty_table(nothing):
    assert quality.judge(nothing).count() == 0


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "b", 0.1, 3)] * 2, "doc_id long, text string, votes string, quality double, n_words int")
    rows = quality.judge(df).collect()
    assert [(r.n_words, r.kept) for r in rows] == [(10, True)] * 2
