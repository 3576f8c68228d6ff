"""Landed feed files of the registered query: few files, all items."""

from newsflow.catalog import queries
from newsflow.catalog.views import Views


def test_files_do_not_grow_with_every_few_ids(spark, tmp_path, monkeypatch):
    rows = [(n * 10, f"Report {n}. " + "word " * 30, "en", f"src{n % 2}", 160) for n in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(queries, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    got = queries.QUERIES["feed_files"](Views(spark, f"{tmp_path}/in")).collect()
    assert sum(r.n for r in got if r.url) == sum(1 for n, *_ in rows if n % 17 != 5)
    assert sum(r.n for r in got if not r.url) == 2
    # Per source one file of items, one of entries, one that breaks off.
    assert len([p for p in (tmp_path / "feeds").rglob("part-*") if p.suffix == ".txt"]) == 6
