"""Document quality by weak supervision (operator 7).

Nine rules over counts of the text each vote good or bad or abstain. Expectation-maximisation estimates, for each
hidden class, how often each rule votes bad where it votes, from how the rules agree; the posterior probability of
good then decides, in place of all rules having to pass. Rules that other rules bear out get a high rate among the bad,
and one bad vote of a rule that errs on good documents does not drop a document. EM starts from the share of good
votes, and its rates have weak priors, worth a few documents. It sees the numbers of documents with each pattern of
votes, counted by Spark over all documents; there are at most 3^9 patterns, whatever the input. The verdict joins back
by pattern. Labels are never read.

Cases: documents with equal votes get equal verdicts, and a posterior equal to the limit is kept; null or empty text has no words and fails the base rules; each row is judged alone, so repeated rows and null
ids get results of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.textops import Words, mix, rolling

SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_punctuation", "n_mute")
SCHEMA = "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES)


def _lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in text.split(b"\n") if x.strip(textops.WHITE)]
    return len(lines), len(lines) - len(set(lines))


def measure(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of each whole text that the rules read."""
    letters = [np.zeros(256, bool) for _ in range(6)]
    letters[0][list(SYMBOLS)] = letters[1][65:91] = letters[2][97:123] = letters[3][33] = True
    letters[4][:128] = letters[4][192:] = True  # the first byte of a code point
    letters[5] = letters[1] | letters[2]
    letters[5][48:58] = letters[5][128:] = True  # digits and letters, as far as bytes tell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, 1, 2 << 20):
                w = Words(part.column(1))
                n, rows = part.num_rows, w.rows

                def per_row(flags: np.ndarray, rows=rows) -> np.ndarray:
                    at = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
                    return at[rows[1:]] - at[rows[:-1]]

                windows = rolling(w.hashes, 5)
                at = np.flatnonzero(w.left()[: len(windows)] >= 5)
                row = w.row()
                salted = mix(windows[at] + mix(row[at].astype(np.uint64)))
                order = np.argsort(salted)
                same = salted[order][1:] == salted[order][:-1]
                twice = np.zeros(len(at), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                turn = np.zeros(len(w.starts) + 1, np.int64)
                turn[at[twice]] += 1
                turn[at[twice] + 5] -= 1
                covered = np.concatenate(([0], np.cumsum(np.cumsum(turn)[:-1] > 0)))
                spelled = np.concatenate(([0], np.cumsum(letters[5][w.data])))
                mute = np.concatenate(([0], np.cumsum(spelled[w.ends] == spelled[w.starts])))
                lines = [_lines(bytes(w.data[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                columns = [
                    w.counts, per_row(letters[4][w.data] & w.solid), per_row(letters[0][w.data]), [x[1] for x in lines], covered[w.bounds[1:]] - covered[w.bounds[:-1]],
                    [x[0] for x in lines], per_row(letters[1][w.data]), per_row(letters[2][w.data]), per_row(letters[3][w.data]),
                    per_row(~letters[5][w.data] & w.solid), mute[w.bounds[1:]] - mute[w.bounds[:-1]],
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *FEATURES])

    return textops.keyed(docs, {"doc_id": id_column, "text": text_column}).mapInArrow(textops.releasing(run), SCHEMA)


def _vote(value, good, bad):
    return F.when(bad(value), "b").when(good(value), "g").otherwise("-")


def votes():
    """One letter for each rule: g(ood), b(ad) or - (abstains)."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    cased = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    below, above = (lambda x: lambda v: v < x), (lambda x: lambda v: v > x)
    mean = F.col("word_chars") / words
    rules = [
        _vote(F.col("n_words"), above(49), below(10)),
        F.when(~mean.between(2.5, 14), "b").when(mean.between(3, 10), "g").otherwise("-"),
        _vote(F.col("n_symbols") / words, below(0.02), above(0.1)),
        _vote(F.col("n_dup_lines") / lines, below(0.05), above(0.3)),
        _vote(F.col("n_repeat_words") / words, below(0.05), above(0.2)),
        _vote(F.col("n_upper") / cased, below(0.15), above(0.4)),
        F.when(F.col("n_words") < 15, "-").otherwise(_vote(F.col("n_marks") / words, below(0.05), above(0.2))),
        _vote(F.col("n_punctuation") / F.greatest(F.col("word_chars"), F.lit(1)), below(0.06), above(0.12)),
        _vote(F.col("n_mute") / words, below(0.05), above(0.2)),
    ]
    return F.concat(*rules)


#: Beta priors of the rate of bad votes among good and among bad documents, and of the share of good ones, as
#: (votes of the first kind, votes of the second kind): worth ten documents and four.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE = (0.1, 9.9), (3.0, 7.0), (2.0, 2.0)


def fit(counts: dict[str, int], rounds: int = 500) -> dict[str, float]:
    """EM over vote patterns: the posterior probability of good for each."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    bad = np.array([[c == "b" for c in p] for p in patterns], float)
    good = np.array([[c == "g" for c in p] for p in patterns], float)
    post = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)  # of good, to start with: the share of good votes
    for _ in range(rounds):
        share = (weight @ post + PRIOR_SHARE[0]) / (weight.sum() + sum(PRIOR_SHARE))
        log = []
        for p, prior, (fails, passes) in ((post, share, PRIOR_GOOD), (1 - post, 1 - share, PRIOR_BAD)):
            w = weight * p
            rate = (w @ bad + fails) / (w @ (bad + good) + fails + passes)  # of bad votes, for each rule
            log.append(np.log(prior) + bad @ np.log(rate) + good @ np.log(1 - rate))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist(), strict=True))


def judge(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, the base verdict, the posterior probability of good and whether the document is kept."""
    rows = textops.cut(measure(docs, id_column=id_column, text_column=text_column).withColumn("votes", votes()))
    posterior = fit({r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()})  # at most 3^9 rows
    table = rows.sparkSession.createDataFrame(list(posterior.items()), "votes string, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.join(F.broadcast(table), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= least)).alias("kept"), "quality", "votes",
    )
