"""Token streams, binding, phrase search and region joins (ids S1, S2, S16, J1-J6, J12, P1-P4, V3, F12-F16 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import tables


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_idx, line): the non-blank lines of a text."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_idx", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def token_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, tok) in text order; a document without text has no rows, which is not an empty set of evidence."""
    return docs.select("doc_id", F.posexplode(V.tokens(F.col(text))).alias("pos", "tok"))


def flatten_words(ocr: DataFrame, *more: str) -> DataFrame:
    """Nested pages, blocks, lines and words as one row for each non-blank word, in document order; ``more`` fields of
    the words come along."""
    rows = ocr.select("doc_id", F.posexplode("pages").alias("page_ord", "p"))
    rows = rows.select("doc_id", F.col("p.page_idx").alias("page_idx"), F.posexplode("p.blocks").alias("block_idx", "b"))
    rows = rows.select("doc_id", "page_idx", "block_idx", F.posexplode("b.lines").alias("line_idx", "l"))
    rows = rows.select("doc_id", "page_idx", "block_idx", "line_idx", F.posexplode("l.words").alias("word_idx", "w"))
    corner = lambda i, j: F.get(F.get(F.col("w.geometry"), F.lit(i)), F.lit(j))
    return rows.select(
        "doc_id", "page_idx", "block_idx", "line_idx", "word_idx", F.trim("w.value").alias("value"), corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(1, 0).alias("x1"), corner(1, 1).alias("y1"), *[F.col(f"w.{c}").alias(c) for c in more]
    ).where("value <> ''")


def assemble_lines(words: DataFrame) -> DataFrame:
    """The words of each line joined by a space in word order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "value"))), lambda x: x["value"])
    return words.groupBy("doc_id", "page_idx", "block_idx", "line_idx").agg(F.array_join(ordered, " ").alias("text"))


def bind(drafts: DataFrame, tokens: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(draft_id, doc_id, matched, wanted, admitted): distinct tokens of each draft found in its own document."""
    own = drafts.select("draft_id", "doc_id", F.explode(F.array_distinct(V.tokens(F.col("value")))).alias("tok"))
    hay = tokens.select("doc_id", "tok", F.lit(1).alias("hit")).distinct()
    found = own.join(hay, ["doc_id", "tok"], "left").groupBy("draft_id", "doc_id").agg(F.count("hit").alias("matched"), F.count("*").alias("wanted"))
    return found.withColumn("admitted", F.col("matched") >= threshold * F.col("wanted"))


def bind_anywhere(drafts: DataFrame, tokens: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(draft_id, doc_id, matched, wanted) of all documents that hold enough of a draft's tokens.

    An inverted index: only the rarest tokens of a draft propose documents, as many as a document must share at least
    one of; the rest are counted for proposed pairs only.
    """
    own = drafts.select("draft_id", F.explode(F.array_distinct(V.tokens(F.col("value")))).alias("tok"))
    hay = tokens.select("doc_id", "tok").distinct()
    needed = hay.join(own.select("tok").distinct(), "tok", "left_semi")
    frequency = needed.groupBy("tok").agg(F.count("*").alias("df"))
    sized = own.join(frequency, "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_draft = Window.partitionBy("draft_id")
    sized = sized.withColumns({"wanted": F.count("*").over(per_draft), "rank": F.row_number().over(per_draft.orderBy("df", "tok"))})
    proposing = sized.where(F.col("rank") <= F.col("wanted") - F.ceil(threshold * F.col("wanted")) + 1)
    pairs = proposing.join(needed, "tok").select("draft_id", "doc_id", "wanted").distinct()
    matched = pairs.join(own, "draft_id").join(needed, ["doc_id", "tok"]).groupBy("draft_id", "doc_id", "wanted").agg(F.count("*").alias("matched"))
    return matched.where(F.col("matched") >= threshold * F.col("wanted")).select("draft_id", "doc_id", "matched", "wanted")


#: Rows up to which a lexicon is broadcast; a larger one is shuffled.
LEXICON_ROWS = 100_000


def _small(lexicon: DataFrame) -> DataFrame:
    return F.broadcast(lexicon) if lexicon.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS else lexicon


def phrase_hits(stream: DataFrame, phrases: DataFrame, longest: int, fuzzy: bool = False) -> DataFrame:
    """(phrase_id, doc_id, pos, n) of each occurrence of a phrase (phrase_id, toks array).

    With ``fuzzy`` one token of six letters or more may differ by one edit; candidates meet by an exact other token.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = stream.withColumn("run", F.array(*[F.lead("tok", i).over(w) if i else F.col("tok") for i in range(longest)]))
    lexicon = _small(phrases.select("phrase_id", "toks", F.size("toks").alias("n"), F.get("toks", F.lit(0)).alias("first")))
    exact = ahead.join(lexicon, F.col("tok") == F.col("first")).where(F.slice("run", F.lit(1), F.col("n")) == F.col("toks"))
    hits = exact.select("phrase_id", "doc_id", "pos", "n")
    if not fuzzy:
        return hits
    # a phrase with one long token misread: equal elsewhere, one edit there
    long = lexicon.select("phrase_id", "toks", "n", F.posexplode("toks").alias("k", "long")).where(F.length("long") >= 6)
    at = stream.select("doc_id", F.col("pos").alias("at"), F.col("tok").alias("near")).where(F.length("near") >= 5)
    block = lambda t: F.array(F.substring(t, 1, 3), F.concat(F.lit("$"), F.substring(t, -3, 3)))
    near = at.withColumn("b", F.explode(block(F.col("near")))).join(_small(long.withColumn("b", F.explode(block(F.col("long"))))), "b")
    near = near.where((F.levenshtein("near", "long", 1) == 1)).select("doc_id", (F.col("at") - F.col("k")).alias("pos"), "k", "phrase_id", "toks", "n").distinct()
    same = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == F.col("k")) | (F.get("run", i) == F.get("toks", i)))
    more = near.join(ahead, ["doc_id", "pos"]).where(same).select("phrase_id", "doc_id", "pos", "n")
    return hits.union(more).distinct()


def near_terms(stream: DataFrame, hits: DataFrame, terms: list[str], reach: int = 12) -> DataFrame:
    """For each hit whether a term stands within ``reach`` tokens before it or after its end."""
    last = F.max(F.when(F.col("tok").isin(*terms), F.col("pos"))).over(Window.partitionBy("doc_id").orderBy("pos"))
    next_ = F.min(F.when(F.col("tok").isin(*terms), F.col("pos"))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing))
    marked = stream.select("doc_id", "pos", last.alias("before"), next_.alias("after"))
    near = (F.col("pos") - F.col("before") <= reach) | (F.col("after") - F.col("pos") <= F.col("n") - 1 + reach)
    return hits.join(marked, ["doc_id", "pos"]).select("phrase_id", "doc_id", "pos", F.coalesce(near, F.lit(False)).alias("in_context"))


def _read(hits: DataFrame, name: str) -> DataFrame:
    """(box_id, ``name``): the words that a box meets by y, x, text; each once, though an id may have several places."""
    rows = hits.groupBy("box_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "value", "word_id"))).alias("w"), (F.min("place") == F.max("place")).alias("one"))
    once = F.filter("w", lambda w, i: (i == 0) | ~w.eqNullSafe(F.get("w", i - 1)))
    return rows.select("box_id", F.array_join(F.transform(F.when(F.col("one"), F.col("w")).otherwise(once), lambda w: w["value"]), " ").alias(name))


def region_text(words: DataFrame, boxes: DataFrame, pad: float = 0.03, height: float = 1.0, cells: int = 20) -> DataFrame:
    """(box_id, text): words that intersect the padded box on its page, by y, x, text. Pages are cut into bands, so a
    box meets only the words of the bands that it touches, and each word once, in the first band that both touch;
    ``height`` is a page's."""
    band = lambda y: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(y * (cells / height)))).cast("int")
    wide = boxes.select("box_id", "page", *[(F.col(c) + s * pad).alias(f"b{c}") for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))], F.monotonically_increasing_id().alias("place"))
    wide = wide.withColumn("band", F.explode(F.sequence(band(F.col("by0")), band(F.col("by1"))))).withColumn("first_box", F.col("band") == band(F.col("by0")))
    placed = words.withColumn("band", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1"))))).withColumn("first_word", F.col("band") == band(F.col("y0")))
    meets = (F.col("x0") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))
    hit = placed.join(wide, ["page", "band"]).where(meets & (F.col("first_box") | F.col("first_word")))
    return _read(hit, "text")


def left_label(words: DataFrame, boxes: DataFrame, height: float = 1.0, cells: int = 20) -> DataFrame:
    """(box_id, label): words left of the box within its vertical extent, in reading order; NONE without any. A box meets
    the words of the bands of its page that it touches, each once; ``height`` is a page's."""
    band = lambda y: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(y * (cells / height)))).cast("int")
    wide = boxes.select("box_id", "page", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("y1").alias("by1"), F.monotonically_increasing_id().alias("place"))
    wide = wide.withColumn("band", F.explode(F.sequence(band(F.col("by0")), band(F.col("by1"))))).withColumn("first_box", F.col("band") == band(F.col("by0")))
    placed = words.withColumn("band", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1"))))).withColumn("first_word", F.col("band") == band(F.col("y0")))
    meets = (F.col("x1") <= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))
    hit = placed.join(wide, ["page", "band"]).where(meets & (F.col("first_box") | F.col("first_word")))
    return boxes.select("box_id").join(_read(hit, "label"), "box_id", "left").select("box_id", F.coalesce("label", F.lit("NONE")).alias("label"))


def nearest(points: DataFrame, labels: DataFrame, most: float | None = None, per_cell: int = 4) -> DataFrame:
    """(point_id, label_id, side, distance2) of the nearest label on the same page; ties go to the smaller id.

    Pages are cut into cells, fine enough that the fullest page has about ``per_cell`` labels in each. A point meets the
    labels of its cell and those around it, and is done if the nearest is no further than a cell is wide; the others go
    on with cells four times as wide, the last as wide as all pages. So no point meets all labels of a full page.
    """
    found, rest = [], points.select("point_id", "page", "x", "y")
    bounds = labels.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).union(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"))).collect()  # two rows
    known = [float(v) for r in bounds for v in r if v is not None]
    fullest = labels.groupBy("page").count().agg(F.max("count")).first()[0] or 1
    extent = max(known) - min(known) + 1 if known else 1.0
    width = max(extent / max(1.0, (fullest / per_cell) ** 0.5), 1e-9)
    side = labels.select("label_id", "page", "side", F.col("x").alias("lx"), F.col("y").alias("ly"))
    d2 = F.pow(F.col("x") - F.col("lx"), 2) + F.pow(F.col("y") - F.col("ly"), 2)
    while True:
        last = width >= extent
        cell = lambda c, w=width: F.floor(c / w).cast("long")
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        spread = rest.withColumn("cx", around(F.col("x"))).withColumn("cy", around(F.col("y")))
        pairs = spread.join(side.withColumns({"cx": cell(F.col("lx")), "cy": cell(F.col("ly"))}), ["page", "cx", "cy"]).withColumn("distance2", d2)
        pairs = pairs.where(F.col("distance2") <= most * most) if most is not None else pairs
        best = pairs.groupBy("point_id").agg(F.min(F.struct("distance2", "label_id", "side")).alias("m")).select("point_id", "m.label_id", "m.side", "m.distance2")
        best = tables.cut(best if last else best.where(F.col("distance2") <= width * width))
        found.append(best)
        if last:
            return reduce(lambda a, b: a.unionByName(b), found)
        rest = tables.cut(rest.join(best.select("point_id"), "point_id", "left_anti"))
        if rest.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)
        width = min(4 * width, extent)


def covering_spans(drafts: DataFrame, spans: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(draft_id, doc_id, span, matched, wanted) of the spans of a draft's own document that hold enough of its tokens.

    ``drafts`` has draft_id, doc_id, value; ``spans`` doc_id, span, text.
    """
    own = drafts.select("draft_id", "doc_id", F.explode(F.array_distinct(V.tokens(F.col("value")))).alias("tok"))
    hay = spans.select("doc_id", "span", F.explode(F.array_distinct(V.tokens(F.col("text")))).alias("tok"))
    wanted = own.groupBy("draft_id", "doc_id").agg(F.count("*").alias("wanted"))
    found = own.join(hay, ["doc_id", "tok"]).groupBy("draft_id", "doc_id", "span").agg(F.count("*").alias("matched"))
    return found.join(wanted, ["draft_id", "doc_id"]).where(F.col("matched") >= threshold * F.col("wanted"))


def admit(drafts: DataFrame, tokens: DataFrame, fields: tuple[str, ...] = V.NAMES, threshold: float = 0.8) -> DataFrame:
    """The drafts with ``outcome``: the first reason that keeps a draft out (it names a claim itself, its field is
    unknown, it says nothing, its document does not hold its tokens), or ``admitted``; and with its coverage.

    ``drafts`` has draft_id, doc_id, field, value, claim_id. What is kept out stays in the table.
    """
    bound = bind(drafts, tokens, threshold).select("draft_id", "doc_id", "matched", "wanted", F.col("admitted").alias("bound"))
    rows = drafts.join(bound, ["draft_id", "doc_id"], "left")
    empty = F.size(F.coalesce(V.tokens(F.col("value")), F.array().cast("array<string>"))) == 0
    outcome = (
        F.when(F.col("claim_id").isNotNull(), "prewritten_id").when(~F.coalesce(F.col("field").isin(*fields), F.lit(False)), "unknown_field").when(empty, "empty")
        .when(~F.coalesce("bound", F.lit(False)), "unbound").otherwise("admitted")
    )
    return rows.select(*drafts.columns, outcome.alias("outcome"), (F.col("matched") / F.col("wanted")).alias("coverage"))


def locate(hits: DataFrame, words: DataFrame) -> DataFrame:
    """The hits (phrase_id, doc_id, pos, n) with the page of their first word and the box around their words.

    ``words`` has doc_id, pos, page, x0, y0, x1, y1. A hit that runs on to the next page is none.
    """
    spread = hits.withColumn("at", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)))
    rows = spread.join(words.withColumnRenamed("pos", "at"), ["doc_id", "at"]).groupBy("phrase_id", "doc_id", "pos", "n")
    rows = rows.agg(F.min("page").alias("page"), F.max("page").alias("__last"), F.count("*").alias("__n"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    return rows.where("page = __last AND __n = n").drop("__last", "__n")


def first_hit(located: DataFrame, phrases: DataFrame) -> DataFrame:
    """The one hit of each document that counts: of its first page with a hit, the earliest phrase of the list, then the
    earliest place. ``phrases`` has phrase_id and ord."""
    rows = located.join(F.broadcast(phrases.select("phrase_id", "ord")), "phrase_id")
    rest = [c for c in located.columns if c not in ("doc_id", "page", "pos")]
    best = rows.groupBy("doc_id").agg(F.min(F.struct("page", "ord", "pos", *rest)).alias("m"))
    return best.select("doc_id", "m.*").drop("ord")


def merged_box(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def relative_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pixel boxes (box_id, page, x, y, width, height) as page shares, several of one id and page joined."""
    rel = boxes.join(pages.select("page", F.col("width").alias("pw"), F.col("height").alias("ph")), "page").where("pw > 0 AND ph > 0")
    rel = rel.select("box_id", "page", (F.col("x") / F.col("pw")).alias("x0"), (F.col("y") / F.col("ph")).alias("y0"), ((F.col("x") + F.col("width")) / F.col("pw")).alias("x1"), ((F.col("y") + F.col("height")) / F.col("ph")).alias("y1"))
    return merged_box(rel, "box_id", "page")


def folded_contains(value: Column, region: Column) -> Column:
    """Whether the region holds the value, both without anything but letters and digits; null if the value is empty."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(fold(value) != "", fold(region).contains(fold(value)))
