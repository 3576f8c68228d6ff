"""The decision log on disk."""

import os

from newsflow.catalog import queries
from newsflow.catalog.views import Views
from newsflow.sources import tables


def test_log_is_json_lines_in_compressed_files(spark, tmp_path):
    rows = spark.createDataFrame([(n, "the same words over and over " * 40) for n in range(200)], "n int, text string").coalesce(1)
    for _ in range(2):
        tables.write_json_lines(rows, f"{tmp_path}/log")
    held = sum(os.path.getsize(f"{tmp_path}/log/{f}") for f in os.listdir(f"{tmp_path}/log") if f.startswith("part-"))
    assert held < 2 * 200 * 29 * 40 / 10
    back = spark.read.schema("n int, text string").json(f"{tmp_path}/log")
    assert sorted(back.collect()) == sorted(rows.collect() * 2)


def test_texts_of_decisions_are_not_kept_beside_the_log(spark, tmp_path, monkeypatch):
    rows = [(n, f"Title {n} tells of word{n % 7} and things", "en", "src1") for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(n, n % 2, n % 3 % 2) for n in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, cut = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df: (kept.append(df.columns), cut(df))[1])
    found = queries.QUERIES["decision_log"](Views(spark, str(tmp_path)))
    assert {"candidate_text", "matched_text"} <= set(found.columns) and found.count() == 10 + 2 * 40
    assert found.filter("candidate_text IS NULL OR matched_text IS NULL").isEmpty()
    assert kept and not any({"candidate_text", "matched_text"} & set(columns) for columns in kept)
