"""Vocabularies over titles with letters outside ASCII."""

import duckdb
import __spark_entry__ as E


def test_word_ends_before_a_letter_outside_ascii(spark, tmp_path):
    titles = ["und\u00fcber", "der und die", "\u00e9de", "the", "bundle", "hunde und\u00df", "de", None]
    rows = [(i, "u", None if t is None else f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.dropped: r.changed for r in E.queries()["a30_vocabulary_ablation"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == dict(c.execute(E.oracle_sql()["a30_vocabulary_ablation"]).fetchall())
    assert found == {"the": 1, "ation": 0, "de": 2, "und": 3, "none_of_it": 0}
