import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from newsflow.llm import chat, queries, sharding

ROOT = "/root/testdata/sf0.001"
PROBE = "</s>[INST] ok [/INST]"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, ROOT)
    expected = con.sql(queries.SQL[name])
    order = sorted(rows.columns)
    assert order == sorted(expected.columns)
    assert sorted(tuple(r) for r in rows.select(order).collect()) == sorted(expected.select(", ".join(order)).fetchall())


def test_registered_with_the_rest():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_chat_reads_back_any_text(spark):
    nasty = ["<|end|>", "<\\|end|>", "\\", "\\\\<|", "<|text|>x<|turn|>", "<", "|", "", None, "é😀\n\r\n", PROBE, "<<|end|>", "\\<|"]
    rows = [(k, i, ["system", "user", "assistant", None, "a<|text|>\\"][(i + k) % 5], t, 0) for k in range(5) for i, t in enumerate(nasty)]
    rows += [(7, 0, "user", "q", 0), (7, 1, "assistant", "a", 0), (8, 2, "assistant", "z", 0), (8, 1, "user", "y", 0), (8, 0, "system", "s", 0)]
    rows += [(None, 0, "user", "q", 0), (9, None, "assistant", "b", 0), (9, 1, "user", "c", 0), (9, 1, "user", "c", 0)]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout int")).collect()}
    by_id = {}
    for c, t, role, text, _ in rows:
        by_id.setdefault(c, []).append((t, role, text))
    assert set(got) == set(by_id)
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, turns in by_id.items():
        turns.sort(key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_layouts_by_fingerprint(spark):
    records = spark.sql("""
        SELECT 1 AS id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', CAST(NULL AS STRING))) AS conversations,
            CAST(NULL AS STRING) AS instruction, CAST(NULL AS STRING) AS input, CAST(NULL AS STRING) AS output
        UNION ALL SELECT 2, NULL, 'do', 'this', 'done' UNION ALL SELECT 3, NULL, 'do', NULL, 'done' UNION ALL SELECT 4, NULL, 'alone', NULL, NULL
    """)
    got = {r["id"]: r["turns"] and [(t["role"], t["text"]) for t in r["turns"]] for r in chat.canonical(records, "id").collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [("user", "do\nthis"), ("assistant", "done")], 3: [("user", "do"), ("assistant", "done")], 4: None}
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards_fit_and_only_full_buckets_split(spark):
    rows = [(i if i % 9 else None, "x" * (i * 37 % 400)) for i in range(600)] + [(5, "y" * 5000), (6, None), (7, "")] + [(1, "same" * 50)] * 40
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, shard string, depth int")
    got = sharding.directory(docs, 1000).collect()
    assert len(got) == len(rows) and sorted(r["n_bytes"] for r in got) == sorted(len(t or "") for _, t in rows)
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    for r in got:
        assert size[r["shard"]] == r["shard_bytes"] and len(r["shard"]) == r["depth"]
        assert r["oversized"] == (r["shard_bytes"] > 1000) == (r["n_bytes"] == 5000)
    for a in size:
        assert not any(a != b and b.startswith(a) for b in size)
        if a:
            assert sum(n for b, n in size.items() if b.startswith(a[:-1])) > 1000
    assert sharding.directory(docs.limit(0), 1000).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, ROOT)
        if name != "best_fit_packing":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.select("doc_id").exceptAll(left.select("doc_id")).count() == 0
        out.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/stage-{name}")
        left = spark.read.parquet(path)
    assert left.agg({"length": "max"}).first()[0] <= 2048
    ran = corpus_pipeline.run(spark, ROOT)
    assert ran.select("doc_id", "piece", "ids_crc32").exceptAll(left.select("doc_id", "piece", "ids_crc32")).count() == 0 and ran.count() == left.count()


CLASHES = (
    "spans", "base", "n_assign", "format_score", "carry_0", "words", "hashes", "kept", "score", "_row", "_document", "_gone", "gone",
    "document", "text_md5", "text_id", "_bad_id", "item_id", "n_shingles", "component_id", "key", "label", "piece", "a.b c",
)


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"extra {i}"))
    docs = docs.withColumn("registers", F.struct(F.lit(1).alias("x"), F.current_timestamp().alias("at")))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, ROOT)
        assert left.columns == docs.columns, name
        left.write.parquet(path := f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/named-{name}")
        left = spark.read.parquet(path)
    assert left.count() > 0
    for i, c in enumerate(CLASHES):
        assert [r[0] for r in left.select(F.col(f"`{c}`")).distinct().collect()] == [f"extra {i}"]
    assert corpus_pipeline.STAGES[-1][1](spark, left, ROOT).count() > 0


def test_pipeline_survives_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "word " * 30, "en", "s", 7), (1, "word " * 30, "en", "s", 7), (2, " ".join(f"w{i}" for i in range(40)) + " token=abcdef0123", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        folder = f"{tmp_path}/{empty}"
        (docs.limit(0) if empty else docs).write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{ROOT}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        assert corpus_pipeline.run(spark, folder).count() == (0 if empty else 1)
