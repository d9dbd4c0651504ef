"""Queries over token streams, phrases and geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotforge.functions import values as V
from slotforge.operators import blocks, metrics, text
from slotforge.queries import query
from slotforge.queries.base import table

TOKENS = "tk AS (SELECT doc_id, unnest(t) tok, generate_subscripts(t, 1) - 1 pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t FROM documents))"
PHRASES = [("p1", ["the"]), ("p2", ["of", "the"]), ("p3", ["licensed", "under", "the"]), ("p4", ["apache", "license"])]
FUZZY = [("f1", ["the", "apache", "licence"]), ("f2", ["licensed"]), ("f3", ["under", "the", "apoche"])]


def _stream(spark, d):
    return text.token_stream(table(spark, d, "documents"))


def _lexicon(spark, rows):
    return spark.createDataFrame(rows, "phrase_id string, toks array<string>")


@query("s2_lines", "SELECT doc_id, count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') l FROM documents) WHERE l <> '' GROUP BY 1")
def s2(spark, d):
    return text.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


@query("s16_tokens", f"WITH {TOKENS} SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs, min(pos) AS first_pos FROM tk GROUP BY 1")
def s16(spark, d):
    per_doc = _stream(spark, d).groupBy("tok", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return per_doc.groupBy("tok").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("p").alias("first_pos"))


def _drafts(spark, d):
    """Each benchmark text as a draft for the document with a fixed multiple of its id, and for the one that holds it."""
    n = table(spark, d, "documents").count()
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("draft_id"), F.explode(F.array(F.col("item_id") * 7 % n, F.col("item_id") * 3 % n)).alias("doc_id"), F.col("text").alias("value"))
    return items.distinct()


@query("j1_f8_binding", f"""WITH {TOKENS}, n AS (SELECT count(*) n FROM documents), dr AS (SELECT DISTINCT item_id draft_id, unnest([item_id * 7 % n, item_id * 3 % n]) doc_id, text FROM benchmark, n),
own AS (SELECT DISTINCT draft_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok FROM dr), hay AS (SELECT DISTINCT doc_id, tok, 1 hit FROM tk)
SELECT draft_id, doc_id, count(hit) AS matched, count(*) AS wanted, count(hit) >= 0.8 * count(*) AS admitted FROM own LEFT JOIN hay USING (doc_id, tok) GROUP BY 1, 2""")
def j1(spark, d):
    return text.bind(_drafts(spark, d), _stream(spark, d))


@query("j2_binding_anywhere", f"""WITH {TOKENS}, own AS (SELECT DISTINCT item_id draft_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok FROM benchmark), hay AS (SELECT DISTINCT doc_id, tok FROM tk),
w AS (SELECT draft_id, count(*) wanted FROM own GROUP BY 1) SELECT draft_id, doc_id, count(*) AS matched, wanted FROM own JOIN hay USING (tok) JOIN w USING (draft_id) GROUP BY 1, 2, 4 HAVING count(*) >= 0.8 * wanted""")
def j2(spark, d):
    drafts = table(spark, d, "benchmark").select(F.col("item_id").alias("draft_id"), F.col("text").alias("value"))
    return text.bind_anywhere(drafts, _stream(spark, d))


@query("r5_a4_freeze_outcomes", f"""WITH {TOKENS}, n AS (SELECT count(*) n FROM documents), dr AS (SELECT item_id draft_id, CASE WHEN item_id % 7 = 0 THEN 'C-1' END claim_id, CASE WHEN item_id % 5 = 0 THEN 'colour' ELSE 'seller_name' END field,
 CASE WHEN item_id % 11 = 3 THEN ' -- ' ELSE text END v, unnest([item_id * 7 % n, item_id * 3 % n, item_id * 11 % n]) doc_id, item_id % 2 by_ FROM benchmark, n),
own AS (SELECT DISTINCT draft_id, doc_id, unnest(regexp_extract_all(lower(v), '[a-z0-9]+')) tok FROM dr), hay AS (SELECT DISTINCT doc_id, tok, 1 hit FROM tk),
cov AS (SELECT draft_id, doc_id, count(hit) >= 0.3 * count(*) ok FROM own LEFT JOIN hay USING (doc_id, tok) GROUP BY 1, 2)
SELECT CASE WHEN claim_id IS NOT NULL THEN 'prewritten_id' WHEN field = 'colour' THEN 'unknown_field' WHEN len(regexp_extract_all(lower(v), '[a-z0-9]+')) = 0 THEN 'empty' WHEN NOT coalesce(ok, false) THEN 'unbound' ELSE 'admitted' END AS outcome, by_ AS drafted_by, count(*) AS n
FROM (SELECT DISTINCT * FROM dr) LEFT JOIN cov USING (draft_id, doc_id) GROUP BY 1, 2""")
def r5(spark, d):
    """Admission of drafts for documents all over the table: the first reason that applies, counted by drafter."""
    i, n = F.col("item_id"), table(spark, d, "documents").count()
    drafts = table(spark, d, "benchmark").select(
        i.alias("draft_id"), F.when(i % 7 == 0, "C-1").alias("claim_id"), F.when(i % 5 == 0, "colour").otherwise("seller_name").alias("field"),
        F.when(i % 11 == 3, " -- ").otherwise(F.col("text")).alias("value"), F.explode(F.array(*[i * k % n for k in (7, 3, 11)])).alias("doc_id"), (i % 2).alias("drafted_by"),
    ).distinct()
    return text.admit(drafts, _stream(spark, d), threshold=0.3).groupBy("outcome", "drafted_by").agg(F.count("*").alias("n"))


def _phrase_sql(rows, match):
    listed = ", ".join(f"('{i}', {t!r})" for i, t in rows)
    longest = max(len(t) for _, t in rows)
    ahead = ", ".join(f"lead(tok, {k}) OVER w" if k else "tok" for k in range(longest))
    return f"""WITH {TOKENS}, lex(phrase_id, toks) AS (VALUES {listed}), ah AS (SELECT doc_id, pos, [{ahead}] run FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT phrase_id, doc_id, pos, len(toks) n FROM ah, lex WHERE {match})"""


_EXACT = "run[1:len(toks)] = toks"
_NEAR = "(run[1:len(toks)] = toks OR (len(list_filter(range(1, len(toks) + 1), lambda i: run[i] IS DISTINCT FROM toks[i])) = 1 AND len(list_filter(range(1, len(toks) + 1), lambda i: run[i] <> toks[i] AND length(toks[i]) >= 6 AND levenshtein(run[i], toks[i]) = 1)) = 1))"


@query("p1_p3_phrases", _phrase_sql(PHRASES, _EXACT) + " SELECT phrase_id, doc_id, count(*) AS hits, min(pos) AS first_pos FROM hits GROUP BY 1, 2")
def p1(spark, d):
    return text.phrase_hits(_stream(spark, d), _lexicon(spark, PHRASES), 3).groupBy("phrase_id", "doc_id").agg(F.count("*").alias("hits"), F.min("pos").alias("first_pos"))


@query("p2_fuzzy_labels", _phrase_sql(FUZZY, _NEAR) + " SELECT doc_id, phrase_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, n DESC, phrase_id) r FROM hits) WHERE r = 1")
def p2(spark, d):
    """The first label of each document, the longest at its place; one long token may be misread by one letter."""
    hits = text.phrase_hits(_stream(spark, d), _lexicon(spark, FUZZY), 3, fuzzy=True)
    first = hits.groupBy("doc_id").agg(F.min(F.struct("pos", -F.col("n"), "phrase_id")).alias("m"))
    return first.select("doc_id", "m.phrase_id", "m.pos")


_LEXICA = {"f1": "total_net", "f2": "seller_name", "f3": "buyer_name"}
_PROBED = f"(VALUES {', '.join(f'({n!r}, {n in (*_LEXICA.values(), chr(100))})'.replace('True', 'true').replace('False', 'false') for n in V.NAMES)}) pf(field, lex)"


@query("g10_absence_probes", _phrase_sql(FUZZY, _NEAR) + f""", wc AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) END words FROM documents),
hf AS (SELECT DISTINCT doc_id, CASE phrase_id WHEN 'f1' THEN 'total_net' WHEN 'f2' THEN 'seller_name' ELSE 'buyer_name' END field, true seen FROM hits)
SELECT field, CASE WHEN NOT lex THEN 'no_lexicon' WHEN coalesce(words, 0) = 0 THEN 'ocr_unavailable' WHEN seen THEN 'label_present' ELSE 'absent_corroborated' END AS status, count(*) AS n FROM wc CROSS JOIN {_PROBED} LEFT JOIN hf USING (doc_id, field) GROUP BY 1, 2""")
def g10(spark, d):
    """Labels of three fields on every page; a thirteenth of the pages was not read."""
    docs = table(spark, d, "documents")
    names = spark.createDataFrame(list(_LEXICA.items()), "phrase_id string, field string")
    hits = text.phrase_hits(_stream(spark, d), _lexicon(spark, FUZZY), 3, fuzzy=True).join(F.broadcast(names), "phrase_id")
    fields = spark.createDataFrame([(n, n in _LEXICA.values()) for n in V.NAMES], "field string, has_lexicon boolean")
    pages = docs.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.size(V.tokens(F.col("text")))).alias("word_count"))
    return blocks.absence_probes(fields, pages, hits).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("f11_trust", """WITH c AS (SELECT vec_id i, embedding[1] a, embedding[2] b FROM embeddings),
t AS (SELECT CASE WHEN i % 5 <> 0 AND i % 7 <> 0 AND i % 11 <> 0 AND i % 13 <> 0 AND i % 17 <> 0 AND a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND a <= 0.9 AND b <= 0.95 THEN 'invoice' END k,
 i % 3 <> 0 AND i % 4 <> 0 AND i % 19 <> 0 AND i % 23 <> 0 AND i % 29 <> 0 ok FROM c) SELECT k AS doc_class, ok AS absence, count(*) AS n FROM t GROUP BY 1, 2""")
def f11(spark, d):
    """Checks and probes of which some lack a part of their evidence; only complete ones are trusted."""
    i, at = F.col("vec_id"), lambda k: F.get("embedding", F.lit(k)).cast("double")
    box = F.when(i % 17 == 0, F.array(F.array(at(0), at(1)))).otherwise(F.array(F.array(at(0), at(1)), F.array(F.lit(float("0.9")), F.lit(0.95))))
    check = F.struct(
        F.when(i % 5 == 0, "fail").otherwise("pass").alias("status"), F.when(i % 7 == 0, "letter").otherwise("invoice").alias("doc_class"), F.when(i % 11 == 0, " ").otherwise("tax invoice").alias("phrase"),
        F.when(i % 13 == 0, -1).otherwise(0).alias("page"), box.alias("bbox"),
    )
    probe = F.struct(
        F.when(i % 3 == 0, "label_present").otherwise("absent_corroborated").alias("status"), F.when(i % 4 == 0, "hit").alias("evidence"), F.when(i % 19 == 0, "colour").otherwise("due_date").alias("field"),
        F.when(i % 23 == 0, "old").otherwise("now").alias("lexicon_digest"), F.when(i % 29 == 0, 0).otherwise(7).alias("word_count"), F.lit(3).alias("phrases_probed"),
    )
    rows = table(spark, d, "embeddings").select(blocks.trusted_class(check).alias("doc_class"), blocks.trusted_absence(probe, "now").alias("absence"))
    return rows.groupBy("doc_class", "absence").agg(F.count("*").alias("n"))


@query("p4_v3_context", _phrase_sql(PHRASES, _EXACT) + """, terms AS (SELECT doc_id, pos tp FROM tk WHERE tok IN ('and', 'with', 'apache')),
near AS (SELECT h.phrase_id, h.doc_id, h.pos, coalesce(bool_or(tp BETWEEN h.pos - 12 AND h.pos + n - 1 + 12), false) ctx FROM hits h LEFT JOIN terms t ON t.doc_id = h.doc_id AND tp BETWEEN h.pos - 12 AND h.pos + n - 1 + 12 GROUP BY 1, 2, 3)
SELECT phrase_id, count(*) AS hits, count_if(ctx) AS in_context FROM near GROUP BY 1""")
def p4(spark, d):
    stream = _stream(spark, d)
    hits = text.near_terms(stream, text.phrase_hits(stream, _lexicon(spark, PHRASES), 3), ["and", "with", "apache"])
    return hits.groupBy("phrase_id").agg(F.count("*").alias("hits"), F.count_if("in_context").alias("in_context"))


@query("f16_term_classes", f"""WITH {TOKENS}, c AS (SELECT doc_id, count_if(regexp_matches(tok, '^[kw][a-z]{{2,3}}$')) strong, count_if(tok IN ('licensed', 'license', 'copyright')) weak FROM tk GROUP BY 1)
SELECT CASE WHEN strong >= 2 THEN 'strong' WHEN strong + weak > 0 THEN 'weak' ELSE 'none' END AS evidence, count(*) AS docs FROM c GROUP BY 1""")
def f16(spark, d):
    c = _stream(spark, d).groupBy("doc_id").agg(F.count_if(F.col("tok").rlike("^[kw][a-z]{2,3}$")).alias("strong"), F.count_if(F.col("tok").isin("licensed", "license", "copyright")).alias("weak"))
    return c.groupBy(F.when(F.col("strong") >= 2, "strong").when(F.col("strong") + F.col("weak") > 0, "weak").otherwise("none").alias("evidence")).agg(F.count("*").alias("docs"))


GEO = """sz AS (SELECT greatest(count(*) // 20, 1) pages, greatest(count(*) // 20 * 2 // 5, 1) docs FROM embeddings), pts AS (SELECT vec_id word_id, docs, vec_id % pages page, 'w' || label AS value, label, CAST(floor((embedding[1] + 1) * 500) AS BIGINT) x, CAST(floor((embedding[2] + 1) * 500) AS BIGINT) y FROM embeddings, sz)"""
# pages as the survey lays them out: 50 at any size, so the words of a page, and what regions and labels meet, grow with the table
PAGES = 50
FULL = f"""pts AS (SELECT vec_id word_id, vec_id % {PAGES} page, 'w' || label AS value, label, CAST(floor((embedding[1] + 1) * 500) AS BIGINT) x, CAST(floor((embedding[2] + 1) * 500) AS BIGINT) y FROM embeddings)"""


def _pages(spark, d):
    """(pages, documents): twenty words a page and two or three pages a document, whatever the size of the table."""
    pages = max(1, table(spark, d, "embeddings").count() // 20)
    return pages, max(1, pages * 2 // 5)


def _points(spark, d, pages=None):
    """Vectors as words of pages: two components as a place on a grid of thousandths. ``pages`` is their number, by the
    size of the table if not given."""
    # in the floats of the table, as the SQL has it: doubles would put some words a thousandth lower
    grid = lambda i: F.floor((F.get("embedding", F.lit(i)) + F.lit(1).cast("float")) * F.lit(500).cast("float"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), (F.col("vec_id") % (pages or _pages(spark, d)[0])).alias("page"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("value"), "label", grid(0).alias("x"), grid(1).alias("y"))


def _words(spark, d, pages=None):
    p = _points(spark, d, pages)
    return p.select("word_id", "page", "value", "label", (F.col("x") / 1000).alias("x0"), (F.col("y") / 1000).alias("y0"), ((F.col("x") + 20) / 1000).alias("x1"), ((F.col("y") + 10) / 1000).alias("y1"))


def _grid(spark, d, pages=None):
    """The words in whole thousandths of their page."""
    return _words(spark, d, pages).select("word_id", "page", "value", *[F.round(F.col(c) * 1000, 0).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("j4_region_text", f"""WITH {FULL}, b AS (SELECT word_id box_id, page, x, y FROM pts)
SELECT box_id, string_agg(value, ' ' ORDER BY w.y, w.x, value, word_id) AS text FROM b JOIN pts w USING (page) WHERE w.x <= b.x + 50 AND w.x + 20 >= b.x - 30 AND w.y <= b.y + 40 AND w.y + 10 >= b.y - 30 GROUP BY 1""")
def j4(spark, d):
    """The text around each word, with every word's box as a region."""
    grid = _grid(spark, d, PAGES)
    return text.region_text(grid, grid.select(F.col("word_id").alias("box_id"), "page", "x0", "y0", "x1", "y1"), pad=30, height=1000)


@query("j5_left_labels", f"""WITH {FULL}, b AS (SELECT word_id box_id, page, x, y FROM pts)
SELECT box_id, coalesce(string_agg(value, ' ' ORDER BY w.y, w.x, value, word_id), 'NONE') AS label FROM b LEFT JOIN pts w ON w.page = b.page AND w.x + 20 <= b.x AND w.y <= b.y + 10 AND w.y + 10 >= b.y GROUP BY 1""")
def j5(spark, d):
    grid = _grid(spark, d, PAGES)
    return text.left_label(grid, grid.select(F.col("word_id").alias("box_id"), "page", "x0", "y0", "x1", "y1"), height=1000)


@query("j6_citation", f"""WITH {FULL}, b AS (SELECT word_id box_id, page, x, y, label FROM pts),
t AS (SELECT box_id, b.label, string_agg(value, '' ORDER BY w.y, w.x, value, word_id) txt FROM b JOIN pts w USING (page) WHERE w.x <= b.x + 50 AND w.x + 20 >= b.x - 30 AND w.y <= b.y + 40 AND w.y + 10 >= b.y - 30 GROUP BY 1, 2)
SELECT box_id, contains(txt, 'w' || (label + 1) % 10) AS holds FROM t""")
def j6(spark, d):
    region = j4(spark, d)
    labels = _points(spark, d, PAGES).select(F.col("word_id").alias("box_id"), "label")
    return region.join(labels, "box_id").select("box_id", text.folded_contains(F.concat(F.lit("W-"), ((F.col("label") + 1) % 10).cast("string")), F.col("text")).alias("holds"))


@query("j12_nearest_label", f"""WITH {FULL}, l AS (SELECT word_id label_id, page, CASE WHEN label % 2 = 0 THEN 'seller' ELSE 'buyer' END side, x lx, y ly FROM pts WHERE word_id % 500 > 250),
p AS (SELECT word_id point_id, page, x, y FROM pts WHERE word_id % 500 <= 250)
SELECT point_id, label_id, side, d2 AS distance2 FROM (SELECT *, (x - lx) * (x - lx) + (y - ly) * (y - ly) d2, row_number() OVER (PARTITION BY point_id ORDER BY (x - lx) * (x - lx) + (y - ly) * (y - ly), label_id) r FROM p JOIN l USING (page)) WHERE r = 1""")
def j12(spark, d):
    p = _points(spark, d, PAGES)
    side = F.when(F.col("label") % 2 == 0, "seller").otherwise("buyer")
    labels = p.where("word_id % 500 > 250").select(F.col("word_id").alias("label_id"), "page", side.alias("side"), "x", "y")
    points = p.where("word_id % 500 <= 250").select(F.col("word_id").alias("point_id"), "page", "x", "y")
    return text.nearest(points, labels).withColumn("distance2", F.col("distance2").cast("long"))


@query("a33_nearest_side_accuracy", f"""WITH {FULL}, l AS (SELECT word_id label_id, page, label % 2 side, x lx, y ly FROM pts WHERE word_id % 3 = 0 AND page % 9 <> 0), p AS (SELECT word_id point_id, page, label % 2 truth, x, y FROM pts WHERE word_id % 3 <> 0 OR page % 9 = 0),
n AS (SELECT * FROM (SELECT *, (x - lx) * (x - lx) + (y - ly) * (y - ly) d2, row_number() OVER (PARTITION BY point_id ORDER BY (x - lx) * (x - lx) + (y - ly) * (y - ly), label_id) r FROM p JOIN l USING (page)) WHERE r = 1),
s AS (SELECT page FROM l GROUP BY 1 HAVING count(DISTINCT side) > 1), va AS (SELECT 'nearest' variant, side = truth ok FROM n UNION ALL SELECT 'within', side = truth FROM n WHERE d2 <= 10000 UNION ALL SELECT 'closer', side = truth FROM n WHERE page IN (SELECT page FROM s))
SELECT variant, count(*) AS n, count_if(ok) AS correct, (SELECT count(*) FROM p) - count(*) AS skipped, 100 * count_if(ok) >= 55 * count(*) AS survives FROM va GROUP BY 1""")
def a33(spark, d):
    """How often the nearest label's side is right, by variant; every ninth page has no label, all
    their words are points. Every word is a label or a point."""
    p = _points(spark, d, PAGES)
    labels = p.where("word_id % 3 = 0 AND page % 9 <> 0").select(F.col("word_id").alias("label_id"), "page", (F.col("label") % 2).alias("side"), "x", "y")
    points = p.where("word_id % 3 <> 0 OR page % 9 = 0").select(F.col("word_id").alias("point_id"), "page", "x", "y", (F.col("label") % 2).alias("truth"))
    return metrics.side_accuracy(points, labels, 100, 55)


LABEL_PHRASES = [("seller_a", ["w1", "w2"], "seller", 0), ("buyer_a", ["w3"], "buyer", 1), ("seller_b", ["w4", "w5"], "seller", 2), ("buyer_b", ["w6", "w7"], "buyer", 3)]
_LOCATED = f"""WITH {GEO}, wd AS (SELECT *, page % docs doc_id, page // docs pg, row_number() OVER (PARTITION BY page % docs ORDER BY page // docs, y, x, word_id) - 1 pos FROM pts),
lex(phrase_id, toks, side, ord) AS (VALUES {", ".join(f"('{i}', {t!r}, '{s}', {o})" for i, t, s, o in LABEL_PHRASES)}),
ah AS (SELECT *, [value, lead(value) OVER w] run, [pg, lead(pg) OVER w] pgs, [x, lead(x) OVER w] xs, [y, lead(y) OVER w] ys FROM wd WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT phrase_id, side, ord, doc_id, pos, pg page, list_min(xs[1:len(toks)]) x0, list_min(ys[1:len(toks)]) y0, list_max(xs[1:len(toks)]) + 20 x1, list_max(ys[1:len(toks)]) + 10 y1 FROM ah, lex WHERE run[1:len(toks)] = toks AND pgs[len(toks)] = pg)"""


def _located(spark, d):
    """Words of pages in reading order, and where the labels of two sides stand among them."""
    docs = _pages(spark, d)[1]
    grid = _grid(spark, d).withColumns({"doc_id": F.col("page") % docs, "page": F.floor(F.col("page") / docs)})
    words = grid.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "word_id")) - 1).cast("int"))
    stream = words.select("doc_id", "pos", F.col("value").alias("tok"))
    return text.locate(text.phrase_hits(stream, _lexicon(spark, [p[:2] for p in LABEL_PHRASES]), 2), words)


@query("p3_role_labels", _LOCATED + " SELECT doc_id, phrase_id, side, page, pos, x0, y0, x1, y1 FROM hits")
def p3(spark, d):
    """All labels of both sides with page and box."""
    sides = spark.createDataFrame([(p[0], p[2]) for p in LABEL_PHRASES], "phrase_id string, side string")
    return _located(spark, d).join(F.broadcast(sides), "phrase_id").select("doc_id", "phrase_id", "side", "page", "pos", "x0", "y0", "x1", "y1")


@query("p1_first_phrase", _LOCATED + " SELECT doc_id, phrase_id, page, pos, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord, pos) r FROM hits) WHERE r = 1")
def p1_first(spark, d):
    """The label that counts for each document: of the first page that has one, the earliest of the list."""
    order = spark.createDataFrame([(p[0], p[3]) for p in LABEL_PHRASES], "phrase_id string, ord int")
    return text.first_hit(_located(spark, d), order).select("doc_id", "phrase_id", "page", "pos", "x0", "y0", "x1", "y1")


@query("s1_words", f"""WITH {GEO} SELECT word_id, page % docs AS doc_id, page // docs AS page_idx, label // 5 AS block_idx, label % 5 AS line_idx,
 row_number() OVER (PARTITION BY page, label ORDER BY word_id) - 1 AS word_idx, value, x AS x0, y + 10 AS y1 FROM pts WHERE word_id % 9 <> 0""")
def s1(spark, d):
    """Words nested in pages, blocks and lines, some blank, and flattened again."""
    docs = _pages(spark, d)[1]
    w = _words(spark, d).withColumns({"doc_id": F.col("page") % docs, "page_idx": F.floor(F.col("page") / docs).cast("int"), "block_idx": F.floor(F.col("label") / 5), "line_idx": F.col("label") % 5})
    word = F.struct(F.when(F.col("word_id") % 9 != 0, F.col("value")).otherwise(" ").alias("value"), F.array(F.array("x0", "y0"), F.array("x1", "y1")).alias("geometry"), "word_id")
    nest = lambda rows, name, keys, item, order: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("i")))), lambda x: x["i"]).alias(name))
    none = F.lit(None).cast("long")
    # every line of every block, blank ones too, so that places in the lists are the numbers
    lines = nest(w.withColumn("__w", word), "words", ["doc_id", "page_idx", "block_idx", "line_idx"], F.col("__w"), "word_id")
    grid = w.select("doc_id", "page_idx").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("block_idx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("line_idx"))
    lines = grid.join(lines, ["doc_id", "page_idx", "block_idx", "line_idx"], "left").withColumn("words", F.coalesce("words", F.array(F.struct(F.lit(" ").alias("value"), F.array(F.array(F.lit(0.0))).alias("geometry"), none.alias("word_id")))))
    blocks = nest(lines.select("doc_id", "page_idx", "block_idx", "line_idx", F.struct("words").alias("__l")), "lines", ["doc_id", "page_idx", "block_idx"], F.col("__l"), "line_idx")
    pages = nest(blocks.select("doc_id", "page_idx", "block_idx", F.struct("lines").alias("__b")), "blocks", ["doc_id", "page_idx"], F.col("__b"), "block_idx")
    ocr = nest(pages.select("doc_id", F.struct("page_idx", "blocks").alias("__p"), "page_idx"), "pages", ["doc_id"], F.col("__p"), "page_idx")
    flat = text.flatten_words(ocr, "word_id")
    order = Window.partitionBy("doc_id", "page_idx", "block_idx", "line_idx").orderBy("word_idx")
    grid_of = lambda c: F.round(F.col(c) * 1000, 0).cast("long")
    return flat.select("word_id", "doc_id", F.col("page_idx").cast("long"), F.col("block_idx").cast("long"), F.col("line_idx").cast("long"), (F.row_number().over(order) - 1).alias("word_idx"), "value", grid_of("x0").alias("x0"), grid_of("y1").alias("y1"))


@query("f12_f13_boxes", f"WITH {GEO} SELECT page, min(x) AS x0, min(y) AS y0, max(x + 20) AS x1, max(y + 10) AS y1 FROM pts GROUP BY 1")
def f12(spark, d):
    """Pixel boxes of each page as shares of it, joined to one; written back as thousandths."""
    p = _points(spark, d)
    boxes = p.select(F.lit(0).alias("box_id"), "page", (F.col("x") * 2).alias("x"), (F.col("y") * 3).alias("y"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    pages = p.select("page").distinct().select("page", F.lit(2000).alias("width"), F.lit(3000).alias("height"))
    return text.relative_boxes(boxes, pages).select("page", *[F.round(F.col(c) * 1000, 0).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
