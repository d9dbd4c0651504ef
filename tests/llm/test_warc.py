import base64
import gzip
import hashlib
from collections import Counter

import pytest
from slotforge.llm import warc

ROWS = [
    (1, "http://a.example.com/x?q=1#f", "<p>é</p>"), (2, "https://b.example.com:80/", "same"), (3, "http://a.example.com/x?q=1", "same"),
    (4, None, None), (5, "not a url", ""), (6, "http://u:p@Z.org", "same"), (6, "http://z.org/again", "same"), (None, "http://z.org/n", "own"),
    (7, "http://h/\r\nX: y", "line"), (8, "http://h/long", "z" * 200_000), (1, "http://a.example.com/x?q=1#f", "<p>é</p>"), (9, "http://ü.de/ä b", "u"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, sha string")


@pytest.fixture(scope="module")
def archives(spark, pages):
    return warc.write(pages, warc.new_folder(spark), entries=2)


def expected(least=0):
    out = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = [p for p, _, h in ROWS if (h or "").encode() == raw and p is not None]
        first = max(ids) if ids and len(raw) >= least else page
        out.append((page, len(raw), digest, "response" if page == first else "revisit", None if page == first else first))
    return Counter(out)


def test_records_are_read_back(archives):
    found = warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in found.collect()) == expected()


def test_small_payloads_may_all_be_responses(spark, pages):
    found = warc.read(warc.write(pages, warc.new_folder(spark), least_bytes=5)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in found.collect()) == expected(5)


def test_lookup_reads_what_a_full_read_has(spark, archives, pages):
    keys = pages.select(warc.url_key(pages["url"]).alias("k")).distinct().collect()
    every = Counter(r.url_key for r in warc.read(archives).collect())
    found = Counter(r.url_key for r in warc.lookup(archives, pages).collect())
    assert found == every and set(found) == {r.k for r in keys}
    none = spark.createDataFrame([("http://nowhere.example.com/",)], "url string")
    assert warc.lookup(archives, none).count() == 0


def test_lookup_of_pages_finds_each_record_once(spark, archives, pages):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in warc.lookup(archives, pages, id_column="page_id").select(names).collect()) == expected()
    one = spark.createDataFrame([("http://a.example.com/x?q=1", 3), ("http://a.example.com/x?q=1", 99)], "url string, page_id long")
    assert [r.page_id for r in warc.lookup(archives, one, id_column="page_id").collect()] == [3]


def test_many_captures_of_one_url(spark):
    rows = [(i, "http://hot.example.com/", f"<p>{i % 7}</p>") for i in range(500)] + [(1000 + i, f"http://h{i}.example.com/", "x" * i) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    archives = warc.write(pages, warc.new_folder(spark), entries=8)
    found = warc.lookup(archives, pages, id_column="page_id", task_bytes=4000)
    assert sorted(r.page_id for r in found.collect()) == sorted(r[0] for r in rows) and found.rdd.getNumPartitions() > 4
    assert warc.lookup(archives, pages.where("page_id = 3")).count() == 500
    kinds = Counter(r.record_type for r in found.where("page_id < 1000").collect())
    assert kinds == {"response": 7, "revisit": 493}


def test_archives_are_sorted_members(archives):
    keys = []
    for row in archives.orderBy("first_key").collect():
        raw = gzip.decompress(open(f"{row.stem.removeprefix('file:')}.warc.gz", "rb").read())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC-Record-ID") == row.n_records
        keys += [row.first_key, row.last_key]
    assert keys == sorted(keys)


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.Example.com/A?b#c",), ("x",), (None,), ("https://a.b:8/",)], "url string")
    assert [r[0] for r in df.select(warc.url_key(df["url"])).collect()] == ["com,example,www)/A?b", "x", "", "b,a)/"]


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"abc", "d").replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse(raw)


def test_empty_table(spark, pages):
    archives = warc.write(pages.limit(0), warc.new_folder(spark))
    assert warc.read(archives).count() == 0 and warc.lookup(archives, pages, id_column="page_id").count() == 0
