"""Closed-form cases of operators, with nulls, ties and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from slotforge.functions import dates
from slotforge.functions import values as V
from slotforge.operators import blocks, gates, ledger, metrics, routing, sampling, text
from slotforge.sources import readers


def one(spark, expression, *values):
    row = spark.createDataFrame([values or (None,)], ", ".join(f"c{i} string" for i in range(max(1, len(values)))))
    return row.select(expression(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("$ 1,234.56", "1234.56"), ("1.234,56 EUR", "1234.56"), ("CHF 1'234.50", "1234.50"), ("1’234", "1234.00"), ("12,50", "12.50"), ("1,250", "1250.00"), ("1,250,75", "1250.75"),
    ("250000 .00", "250000.00"), ("No 7: 12.5", "12.50"), ("none", None), ("", None), (None, None), ("1.2.3", None), ("5.", "5.00"),
])
def test_amount(spark, raw, want):
    got = one(spark, V.amount, raw)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("f,raw,want", [
    (V.date_key, "2020-01-05", "2020-01-05"), (V.date_key, "x", None), (V.party, "Acme Co., Ltd.", "acme"), (V.party, "Inc.", None), (V.code, "INV-42 a", "inv42a"), (V.code, "--", None),
    (V.plain, "  A  b. ", "a b"), (V.document_class, "Credit Note against Invoice 1", "credit_note"), (V.document_class, "Order Confirmation", "confirmation"), (V.document_class, "reorder", "unmapped"),
    (V.document_class, None, "no_claim"), (V.blank_to_null, " abstain ", None), (V.blank_to_null, " x ", "x"),
])
def test_folds(spark, f, raw, want):
    assert one(spark, f, raw) == want


@pytest.mark.parametrize("a,b,want", [
    ("2026-1-15", "", [2026, 1, 15]), ("15.1.2026", "", [2026, 1, 15]), ("1/15/2026", "", [2026, 1, 15]), ("3/4/2026", "", [2026, 4, 3]), ("3/4/2026", "1/15/2026", [2026, 3, 4]), ("5/2026", "", [2026, 5]), ("99/99", "", None), ("12345-1-1", "", None),
])
def test_date_order(spark, a, b, want):
    f = lambda x, y: V.date_ymd(V.date_parts(x), V.date_order(V.date_parts(x), V.date_parts(y)))
    assert one(spark, f, a, b) == want


def test_qa_bound_is_a_rate(spark):
    keys = spark.range(20000).select(V.unit_hash(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("h"))
    assert 0.17 < keys.where(F.col("h") < V.rate_bound(0.2)).count() / 20000 < 0.23


def test_supersession(spark):
    rows = [("t", "a", 1, None), ("t", "b", 2, "a"), ("t", "c", 3, "b"), ("u", "d", 2, None), ("u", "e", 1, None), ("v", "f", 1, "missing")]
    df = spark.createDataFrame(rows, "target_id string, decision_id string, seq long, supersedes string")
    found = {r.target_id: (r.entries, r.tips, r.conflict, r.tip_id) for r in ledger.project(df).collect()}
    assert found == {"t": (3, 1, False, "c"), "u": (2, 2, True, None), "v": (1, 1, False, "f")}
    assert [tuple(r) for r in ledger.chain_faults(df).collect()] == [("dangling", "f")]
    assert ledger.project(df.limit(0)).count() == 0


def test_gap_of_an_hour_counts_and_one_second_more_does_not(spark):
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("r", at(0), 1), ("r", at(3600), 2), ("r", at(7201), 3)], "r string, decided_at timestamp, seq long")
    assert tuple(ledger.working_time(df, "r").first()) == ("r", 3_600_000_000, 1, 1)


@pytest.mark.parametrize("rows,kind", [
    ([(1, "s", "n", 1, 1), (2, "s", "n", 2, 1)], "content_conflict"), ([(1, "s", "n", 1, 1), (2, "s", "n", 1, 1)], "resubmission"), ([(1, "s", "n", None, 1), (2, "s", "n", 1, 1)], "content_conflict"),
    ([(1, "s", "n", 1, 1), (2, "t", "n", 1, 1)], None), ([(1, None, "n", 1, 1), (2, None, "n", 1, 1)], None), ([(1, "s", "n", 1, 1), (1, "s", "n", 1, 1)], None),
])
def test_duplicates(spark, rows, kind):
    found = gates.duplicates(spark.createDataFrame(rows, "doc_id int, seller string, number string, gross int, date int")).collect()
    assert [r.kind for r in found] == ([kind] if kind else [])


LINES = "doc_id int, line_idx int, line string"


@pytest.mark.parametrize("lines,due,reason", [
    (["Invoice Date: January 5, 2020", "Net 30"], "2020-02-04", None), (["Invoice Date: 2020-01-05", "P/N 30"], None, "no_term"), (["Invoice Date: 2020-01-05", "Net 30 EOM"], None, "term_end_of_month"),
    (["Invoice Date: 2020-01-05", "net 30", "payable within 45 days"], None, "term_several"), (["Invoice Date: 2020-01-05", "net 30, 45 days"], "2020-02-04", None),
    (["Invoice Date: 05/06/2026", "Net 30"], None, "date_ambiguous"), (["Net 30"], None, "no_invoice_date"),
    (["Invoice Date: 1/15/99", "net 10"], "1999-01-25", None), (["Invoice Date: 1/15/26", "net 10"], "2026-01-25", None), (["Invoice Date: 2020-01-05 and 2020-01-06", "net 1"], None, "date_several"),
    (["Date issued 5 March 2021", "Net-15"], "2021-03-20", None), (["Invoice Date: 2020-01-05", "14 days notice"], None, "no_term"), (["Invoice Date: 2020-01-05", "2/10 n/30"], "2020-02-04", None),
    (["Invoice Date: 2020-01-05", "Prepayment"], "2020-01-05", None), (["Invoice Date: 2020-01-05", "30 days after receipt"], None, "no_receipt_date"),
    (["Receipt date 2020-02-01", "30 days from date of receipt"], "2020-03-02", None), (["Date received: 2020-02-01", "due on receipt"], "2020-02-01", None),
    (["Invoice Date: 2020-01-05", "Net 30", "net 30"], "2020-02-04", None), (["Invoice Date: 2020-01-05", "30 days net", "Net 30"], None, "term_several"), (["Invoice Date: 2020-01-05", "end of the month", "net 5"], None, "term_end_of_month"),
])
def test_due_dates(spark, lines, due, reason):
    row = dates.derive_due(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], LINES)).first()
    assert (None if row.due is None else str(row.due), row.reason) == (due, reason)


@pytest.mark.parametrize("lines,want", [
    (["Total net $10.00 commission 1.50", "Gross", "9.00 11.50", "net 3.00"], {("total_net", "$10.00"), ("total_gross", "11.50")}),
    (["Net due 500.00"], {("amount_due", "500.00")}), (["Gross amount 1,250.00 less agency commission 187.50 net amount 1,062.50"], {("total_gross", "1,250.00"), ("total_net", "1,062.50")}),
    (["Gross due 5.00"], set()), (["Amount due", "Balance due 7.00"], {("amount_due", "7.00")}), (["Amount due 7.00", "Total due 8.00"], set()), (["Net amount due 4.00"], {("amount_due", "4.00")}),
    (["Amount due 7.00", "amount payable $7.00"], set()), (["Amount due", "", "7.00"], set()), (["grossly 5.00"], set()),
])
def test_amount_labels(spark, lines, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], LINES)
    assert {(r.field, r.value) for r in blocks.bind_amounts(df).collect()} == want


@pytest.mark.parametrize("lines,want", [
    (["Bill to:", "Acme", "Trading House", "12 High Street", "Remit to", "Station A", "Boston MA 02110"], {("buyer_name", "Acme Trading House"), ("seller_name", "Station A")}),
    (["Agency:", "Smith Media Agency", "Customer", "Acme"], set()), (["Payee", "Smith Media Agency"], set()), (["Please remit to:", "A", "B", "C", "D"], {("seller_name", "A B C")}),
    (["Sold to ACME"], set()), (["Client", "12 Main Road"], set()), (["From", "", "X", "", "Y"], {("seller_name", "X")}), (["Billed to", "C/O Jones", "From", "Z"], {("buyer_name", "C/O Jones"), ("seller_name", "Z")}),
])
def test_party_blocks(spark, lines, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], LINES)
    assert {(r.field, r.value) for r in blocks.suggest_parties(df).collect()} == want


def test_nearest_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(3)
    place = lambda: rng.choice([rng.randrange(40), rng.randrange(1000)])
    labels = [(i, rng.choice([1, 1, 1, 2, 3]), "s", place(), place()) for i in range(300)]
    points = [(i, rng.choice([1, 1, 2, 3, 4]), place(), place()) for i in range(300)]
    want = {}
    for i, page, x, y in points:
        own = [((x - lx) ** 2 + (y - ly) ** 2, k) for k, p, _, lx, ly in labels if p == page]
        if own:
            want[i] = min(own)
    p, q = spark.createDataFrame(points, "point_id int, page int, x int, y int"), spark.createDataFrame(labels, "label_id int, page int, side string, x int, y int")
    assert {r.point_id: (r.distance2, r.label_id) for r in text.nearest(p, q).collect()} == want
    assert {r.point_id for r in text.nearest(p, q, most=30).collect()} == {i for i, (d, _) in want.items() if d <= 900}
    assert text.nearest(p, q.limit(0)).count() == 0 and text.nearest(p.limit(0), q).count() == 0


def test_drafts_are_refused_by_the_first_reason(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id int, text string")
    rows = [(1, 1, "total_net", "a b c d", None), (2, 1, "total_net", "a", "C1"), (3, 1, "colour", "--", None), (4, 1, "total_net", "--", None), (5, 1, "total_net", None, None), (6, 1, "total_net", "a x", None), (7, 9, "total_net", "a", None), (8, 1, None, "a", None)]
    found = text.admit(spark.createDataFrame(rows, "draft_id int, doc_id int, field string, value string, claim_id string"), text.token_stream(docs)).collect()
    assert {r.draft_id: r.outcome for r in found} == {1: "admitted", 2: "prewritten_id", 3: "unknown_field", 4: "empty", 5: "empty", 6: "unbound", 7: "unbound", 8: "unknown_field"}
    assert {r.draft_id: r.coverage for r in found}[6] == 0.5


def test_page_state_decides_which_gates_ran(spark):
    slot = lambda doc, value: [(doc, f, value) for f in V.NAMES]
    said = "doc_id string, field string, value string"
    first = spark.createDataFrame(slot("a", "1") + slot("b", "1") + slot("c", "1") + slot("e", "1"), said)
    second = spark.createDataFrame(slot("a", "1") + slot("b", "1") + slot("d", "1"), said)
    cited = spark.createDataFrame([(x, f, True) for x in "abce" for f in V.NAMES], "doc_id string, field string, holds boolean")
    states = spark.createDataFrame([("b", True, None, None, None), ("c", None, None, True, False), ("d", None, True, None, None), ("e", None, None, True, True)], "doc_id string, ocr_missing boolean, first_missing boolean, second_missing boolean, second_optional boolean")
    rows = gates.slot_facts(gates.evidence(first, second, spark.createDataFrame([], said), cited), states)
    at = {r.doc_id: r for r in rows.where("field = 'seller_name'").collect()}
    gate = lambda g: {k: r[g] for k, r in at.items()}
    assert gate("citation_holds") == {"a": "pass", "b": "unavailable", "c": "pass", "d": "unavailable", "e": "pass"}
    assert gate("cross_mode_agreement") == {"a": "pass", "b": "pass", "c": "unavailable", "d": "unavailable", "e": "unavailable"}
    assert gate("extraction_present")["d"] == "unavailable" and gate("doc_blocked") == {"a": False, "b": True, "c": False, "d": True, "e": False}
    found = {(r.gate_id, r.doc_id) for r in gates.findings(rows).where("severity = 'P0'").collect()}
    assert found == {("ocr_available", "b"), ("first_mode_present", "d"), ("second_mode_present", "c")}
    assert gates.slot_facts(gates.evidence(first, second, spark.createDataFrame([], said), cited)).count() == 50


def test_binding_threshold(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "")], "doc_id int, text string")
    drafts = spark.createDataFrame([(1, 1, "a b c d x"), (2, 1, "a b c x y"), (3, 2, "a"), (4, 1, "--")], "draft_id int, doc_id int, value string")
    found = {r.draft_id: r.admitted for r in text.bind(drafts, text.token_stream(docs)).collect()}
    assert found == {1: True, 2: False, 3: False}


def test_words_lines_and_regions(spark):
    word = lambda v, x, y: (v, 1.0, [[x, y], [x + 0.1, y + 0.03]])
    ocr = spark.createDataFrame([("d", [(0, [([([word("Total", 0.1, 0.5), word("100.00", 0.3, 0.5), word(" ", 0.5, 0.5)],), ([word("INV-42", 0.1, 0.1)],)],)])])], readers.OCR)
    words = text.flatten_words(ocr)
    assert [r.text for r in text.assemble_lines(words).orderBy("line_idx").collect()] == ["Total 100.00", "INV-42"]
    flat = words.select(F.monotonically_increasing_id().alias("word_id"), F.col("page_idx").alias("page"), "value", "x0", "y0", "x1", "y1")
    box = spark.createDataFrame([(1, 0, 0.31, 0.5, 0.39, 0.53)], "box_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert text.region_text(flat, box).first().text == "100.00"
    assert text.left_label(flat, box).first().label == "Total"
    assert text.left_label(flat.limit(0), box).first().label == "NONE"


def _full_page():
    """Words that often stand on the same place, and boxes from all over the page, one id with two places that overlap."""
    import random

    rng = random.Random(5)
    words = [(i, rng.choice([1, 1, 2]), f"w{rng.randrange(5)}", x, y, x + 20, y + rng.choice([10, 120])) for i, x, y in ((i, rng.randrange(-20, 300), rng.randrange(-40, 1100)) for i in range(200))]
    boxes = [(i, rng.choice([1, 2, 3]), x, y, x + 20, y + rng.choice([10, 90])) for i, x, y in ((i, rng.randrange(300), rng.randrange(1000)) for i in range(60))]
    return words, [*boxes, (99, 1, 100, 300, 120, 420), (99, 1, 105, 310, 125, 480)]


def test_region_text_is_that_of_all_pairs(spark):
    words, boxes = _full_page()
    want = {}
    for i, page, x0, y0, x1, y1 in boxes:
        want.setdefault(i, set()).update((y, x, v, k) for k, p, v, x, y, r, b in words if p == page and x <= x1 + 30 and r >= x0 - 30 and y <= y1 + 30 and b >= y0 - 30)
    w, b = spark.createDataFrame(words, "word_id int, page int, value string, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(boxes, "box_id int, page int, x0 int, y0 int, x1 int, y1 int")
    found = text.region_text(w, b, pad=30, height=1000).collect()
    assert sorted((r.box_id, r.text) for r in found) == sorted((i, " ".join(x[2] for x in sorted(s))) for i, s in want.items() if s)


def test_left_label_is_that_of_all_pairs(spark):
    words, boxes = _full_page()
    want = {}
    for i, page, x0, y0, x1, y1 in boxes:
        want.setdefault(i, set()).update((y, x, v, k) for k, p, v, x, y, r, b in words if p == page and r <= x0 and y <= y1 and b >= y0)
    w, b = spark.createDataFrame(words, "word_id int, page int, value string, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(boxes, "box_id int, page int, x0 int, y0 int, x1 int, y1 int")
    found = text.left_label(w, b, height=1000).distinct().collect()
    assert sorted((r.box_id, r.label) for r in found) == sorted((i, " ".join(x[2] for x in sorted(s)) or "NONE") for i, s in want.items())


def test_fuzzy_phrases(spark):
    docs = spark.createDataFrame([(1, "the federai id"), (2, "vat no"), (3, "fedexxx id")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("f", ["federal", "id"]), ("v", ["vit"])], "phrase_id string, toks array<string>")
    assert [(r.phrase_id, r.doc_id, r.pos) for r in text.phrase_hits(text.token_stream(docs), lexicon, 2, fuzzy=True).collect()] == [("f", 1, 1)]


def test_position_is_dense_over_ties(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    rows = routing.ranked(df, F.col("k"), F.col("id")).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(500)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_system_comparison_arithmetic(spark):
    rows = [(1, False, False, True), (1, True, True, True), (2, False, False, True), (2, True, True, False)]
    df = spark.createDataFrame(rows, "doc_id int, deviation boolean, wrong boolean, a boolean")
    r = metrics.compare(df, {"s": F.col("a")}).first()
    assert (r.slots, r.accepted, r.silent, r.deviations, r.docs_released, r.docs_silent) == (4, 3, 1, 2, 1, 1)


def test_bootstrap_covers_the_point(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("d"), F.lit(2).alias("n"))
    r = metrics.bootstrap(docs, 300, "d", "n").first()
    assert r.low < r.point == 0.125 < r.high and 0.02 < r.high - r.low < 0.1


def test_readings_last_line_wins_and_bad_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([(1, "d\ttotal_net\t1\tNet"), (2, "d\ttotal_net\t2"), (3, "short"), (4, "d\tcolour\tred"), (5, "e\ttotal_net\tABSTAIN\t")], "ord int, value string")
    kept, bad = readers.parse_readings(lines, F.lit("A"))
    assert sorted(map(tuple, kept.collect()), key=str) == [("A", "d", "total_net", "2", "NONE"), ("A", "e", "total_net", None, "NONE")]
    assert sorted(r.ord for r in bad.collect()) == [3, 4]


def test_files_are_read_and_written_once(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"doc_id": "a", "mode": "u", "http_status": 200, "data": {"total_net": "1", "x": " "}}\n{"doc_id": "b", "mode": "u", "http_status": 500}\n{"doc_id": \n[1]\n')
    found = readers.read_responses(spark, str(tmp_path / "r.json"))
    assert sorted(r.usable for r in found.collect()) == [False, False, False, True]
    assert [tuple(r) for r in readers.response_drafts(found).collect()] == [("a", "total_net", "1", "mode:u")]
    assert [r.doc_id for r in readers.stored_documents(found, "u").collect()] == ["a"]
    readers.write_once(found, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.write_once(found, str(tmp_path / "out"))
    (tmp_path / "answers.B.tsv").write_text("d\ttotal_net\t5\n")
    kept, _ = readers.read_readings(spark, str(tmp_path / "*.tsv"))
    assert [(r.reader, r.value) for r in kept.collect()] == [("B", "5")]
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.tsv"))
    expected = spark.createDataFrame([(files.first().path,), ("gone",)], "path string")
    assert sorted(r.present for r in readers.register_artifacts(files, expected).collect()) == [False, True]


def test_model_answers_fill_the_grid(spark):
    fields = spark.createDataFrame([("a",), ("b",)], "field string")
    rows = readers.answers(spark.createDataFrame([("d", "a\t1\nz\t2\nnoise")], "doc_id string, text string"), fields)
    assert sorted(map(tuple, rows.collect()), key=str) == [("d", "a", "1"), ("d", "b", None)]


def test_digest_ignores_order_but_not_rows(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("k"))
    digest = lambda f: sampling.content_digest(f, "id", "k").first().digest
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(3)) != digest(df.where("id < 49"))
    assert digest(df) != digest(df.union(df.limit(1)))


def test_set_digests_see_each_id_and_not_order_or_copies(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("k"))
    digests = lambda f: {r.k: (r.n, r.digest) for r in sampling.set_digests(f, "id", "k").collect()}
    want = digests(df)
    assert want == digests(df.union(df).orderBy(F.desc("id")).repartition(3))
    less = digests(df.where("id <> 101"))
    assert less[101 % 3] != want[101 % 3] and all(less[k] == want[k] for k in want if k != 101 % 3)


def test_whole_set_digest_query_reads_every_document(spark):
    from slotforge.queries import QUERIES

    d = "/root/testdata/sf0.001"
    assert sum(r.n for r in QUERIES["a35_set_digests_all"](spark, d).collect()) == spark.read.parquet(f"{d}/documents.parquet").select("lang", "doc_id").distinct().count()
