
import __spark_entry__ as E
import duckdb
import pytest
from oracle import by_spark, rows
from slotforge.queries import QUERIES


@pytest.fixture(scope="module")
def full_pages(tmp_path_factory):
    """4,000 vectors in a small square: 80 words a page, that lie close together and often on the same place."""
    d = str(tmp_path_factory.mktemp("full"))
    vectors = "SELECT i AS vec_id, [(hash(i) % 60)::FLOAT / 125, (hash(i + 9999) % 60)::FLOAT / 125] AS embedding, (i * 7 // 50 % 10)::INT AS label FROM range(4000) t(i)"
    duckdb.connect().execute(f"COPY ({vectors}) TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return d


def by_sql(d, sql):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    r = c.execute(sql)
    return rows(([x[0] for x in r.description], r.fetchall()))


@pytest.mark.parametrize("name", ["j4_region_text", "j5_left_labels", "j6_citation", "j12_nearest_label", "a33_nearest_side_accuracy"])
def test_full_pages(spark, full_pages, name):
    found = by_spark(spark, full_pages, QUERIES[name])
    assert found[1] and found == by_sql(full_pages, E.oracle_sql()[name])


def test_a_region_reads_all_words_of_a_full_page(spark, full_pages):
    found = QUERIES["j4_region_text"](spark, full_pages).selectExpr("count(*) n", "max(size(split(text, ' '))) most").first()
    assert found.n == 4000 and 20 < found.most <= 80


def test_left_labels_read_all_words_of_a_full_page(spark, full_pages):
    found = QUERIES["j5_left_labels"](spark, full_pages).selectExpr("count(*) n", "count_if(label = 'NONE') none", "sum(if(label = 'NONE', 0, size(split(label, ' ')))) words").first()
    pairs = "SELECT count(DISTINCT b.i), count(*) FROM p b JOIN p w ON w.i % 50 = b.i % 50 AND w.x + 20 <= b.x AND abs(w.y - b.y) <= 10"
    points = f"WITH p AS (SELECT vec_id i, floor((embedding[1] + 1) * 500) x, floor((embedding[2] + 1) * 500) y FROM '{full_pages}/embeddings.parquet') "
    labelled, words = duckdb.connect().execute(points + pairs).fetchall()[0]
    assert (found.n, 4000 - found.none, found.words) == (4000, labelled, words)


def test_citations_are_sought_on_a_full_page(spark, full_pages):
    near = "w.i % 50 = b.i % 50 AND w.x <= b.x + 50 AND w.x + 20 >= b.x - 30 AND w.y <= b.y + 40 AND w.y + 10 >= b.y - 30"
    points = f"WITH p AS (SELECT vec_id i, label, floor((embedding[1] + 1) * 500) x, floor((embedding[2] + 1) * 500) y FROM '{full_pages}/embeddings.parquet') "
    held = duckdb.connect().execute(points + f"SELECT count(DISTINCT b.i) FROM p b JOIN p w ON {near} AND w.label = (b.label + 1) % 10").fetchall()[0][0]
    found = QUERIES["j6_citation"](spark, full_pages).selectExpr("count(*) n", "count_if(holds) held").first()
    assert (found.n, found.held) == (4000, held)


def test_nearest_labels_are_those_of_a_full_page(spark, full_pages):
    points = f"WITH p AS (SELECT vec_id i, floor((embedding[1] + 1) * 500) x, floor((embedding[2] + 1) * 500) y FROM '{full_pages}/embeddings.parquet') "
    least = "SELECT b.i, min((b.x - w.x) ** 2 + (b.y - w.y) ** 2)::BIGINT FROM p b JOIN p w ON w.i % 50 = b.i % 50 AND b.i % 500 <= 250 AND w.i % 500 > 250 GROUP BY 1"
    want = dict(duckdb.connect().execute(points + least).fetchall())
    assert {r.point_id: r.distance2 for r in QUERIES["j12_nearest_label"](spark, full_pages).collect()} == want


def test_every_word_is_a_label_or_a_point(spark, full_pages):
    pages = [i % 50 % 9 for i in range(4000)]
    labels = sum(i % 3 == 0 and p != 0 for i, p in enumerate(pages))
    found = {r.variant: r for r in QUERIES["a33_nearest_side_accuracy"](spark, full_pages).collect()}
    assert all(r.n + r.skipped + labels == 4000 for r in found.values()) and set(found) == {"nearest", "within", "closer"}
    assert found["nearest"].skipped == pages.count(0)
