"""Weighted overlap of pairs against a plain sum, and what travels for it."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsflow.catalog.views import Views
from newsflow.functions.text import word_tokens
from newsflow.operators import evidence

PAIR = "batch_id long, cluster_id long, event_id string, tokens_a array<string>, tokens_b array<string>, n_docs long"


def plain(pairs, frequencies):
    sums = defaultdict(lambda: [0.0, 0.0])
    for batch, cluster, event, a, b, n in pairs:
        a, b = (set(a) - {None}, set(b) - {None}) if a is not None and b is not None else (set(), set())
        mine = sums[cluster, event]
        for token in a | b:
            known = [df or 0 for at, t, df in frequencies if at == batch and at is not None and t == token] or [0]
            weight = sum(math.log((n + 1) / (df + 1)) for df in known) if n is not None else 0.0
            mine[0] += weight * (token in a and token in b)
            mine[1] += weight
    return {key: round(s / u, 9) if u else 0.0 for key, (s, u) in sums.items()}


def shuffled(plan):
    """Rows that the shuffles of a finished plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    metric, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(shuffled(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 3, "block_pairs": 2}])
def test_overlap_of_odd_rows(spark, blocks):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["", "é"]
    some = lambda: [draw.choice([*words, None]) for _ in range(draw.randrange(9))]
    pairs = [(n % 3, n, f"e{n % 4}", some(), some(), 5 + n % 3) for n in range(30)]
    pairs += [pairs[4], pairs[4][:3] + (["w1", "w2"], ["w1"], 8), (None, 50, "e", ["w1", "w2"], ["w1"], 4), (9, 51, "e", ["w1", "x"], ["x"], 4)]
    pairs += [(1, 52, "e", None, ["w1"], 4), (1, 53, None, ["w1"], ["w1"], None), (1, None, "e", ["w1", "w3"], ["w1", "w1"], 9), (1, 54, "e", [], [], 9)]
    # A token with two frequencies, one without a number, one as frequent as the documents are many, and keys without pairs.
    frequencies = [(b, w, draw.randrange(1, 5)) for b in (0, 1, 2, 7) for w in words[1:]] + [(0, "w3", 2), (1, "", None), (2, None, 3), (None, "w1", 3)]
    pairs += [(3, 60, "e", ["all"], ["all"], 6), (3, 61, "e", ["all", "w1"], ["all"], 6)]
    frequencies += [(3, "all", 6)]
    known = spark.createDataFrame(frequencies, "batch_id long, token string, df long")
    rows = evidence.weighted_overlap(spark.createDataFrame(pairs, PAIR), known, ["cluster_id", "event_id"], **blocks).collect()
    got = {(r.cluster_id, r.event_id): round(r.overlap, 9) for r in rows}
    want = plain(pairs, frequencies)
    assert len(rows) == len(want) and got == pytest.approx(want, abs=2e-9) and got[60, "e"] == 0


def test_overlap_of_two_key_columns(spark):
    pairs = spark.createDataFrame([("a", 1, 5, ["x", "y"], ["x"], 3), ("b", 1, 6, ["x", "y"], ["x"], 3)],
                                  "k string, l int, pair long, tokens_a array<string>, tokens_b array<string>, n_docs long")
    known = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "x", 1)], "k string, l int, token string, df long")
    got = {r.pair: r.overlap for r in evidence.weighted_overlap(pairs, known, ["pair"], ["k", "l"]).collect()}
    assert got == pytest.approx({5: math.log(2) / (math.log(2) + math.log(4)), 6: 0.5})


def test_tokens_of_pairs_are_not_shuffled_one_by_one(spark):
    tokens = [f"t{i}" for i in range(100)]
    pairs = spark.createDataFrame([(0, n, "e", tokens[:60], tokens[40:], 50) for n in range(40)], PAIR)
    known = spark.createDataFrame([(0, t, 3) for t in tokens], "batch_id long, token string, df long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = evidence.weighted_overlap(pairs, known, ["cluster_id", "event_id"])
        assert {round(r.overlap, 9) for r in rows.collect()} == {0.2}
        # The pairs twice, the frequencies twice (to the splits of large keys, if there are any, and to the pairs).
        assert shuffled(rows._jdf.queryExecution().executedPlan()) <= 2 * 40 + 2 * 100 + 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_are_found_once_per_text(spark, tmp_path):
    texts = [None if n % 17 == 3 else f"The word{'abcdefg'[n % 7]} isn't {'x' * (n % 90)} the End \U0001d400 " + "Zz-yy " * (n % 30) for n in range(140)]
    rows = [(n, t, "en", "src1") for n, t in enumerate(texts)] + [(None, "lost words", "en", "src1"), (60, texts[60], "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    names = ["batch_id", "cluster_id", "event_id", "tokens_a", "tokens_b", "n_docs"]
    want = v._asked.join(evidence.doc_count(v.tokens), "batch_id").withColumns({
        "tokens_a": word_tokens(F.col("text")), "tokens_b": word_tokens(F.col("representative_text"))}).select(*names)
    got = v.candidates.select(*names)
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 200
    assert sorted(v.words.select("batch_id", "tokens").collect(), key=str) == sorted(v.tokens.select("batch_id", "tokens").collect(), key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1


def test_reports_take_the_words_of_a_text_once(spark, tmp_path):
    """The identity rules' pairs equal those made from the texts of both."""
    texts = [None if n % 17 == 3 else "" if n % 23 == 4 else f"The word{'abcdefg'[n % 7]} isn't {'x' * (n % 90)} the End " + "Zz-yy " * (n % 30) for n in range(140)]
    rows = [(n, t, "en", "src1") for n, t in enumerate(texts)] + [(None, "lost words", "en", "src1"), (60, texts[60], "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    none = F.array().cast("array<string>")
    compared = (F.col("unread") | (F.size("entities") == 0)) & F.col("has_texts")
    want = v._asked.join(evidence.doc_count(v.tokens), "batch_id").select(
        "batch_id", "cluster_id", "event_id", "rank", "cosine", F.when(F.col("unread"), none).otherwise(F.col("entities")).alias("new_tokens"),
        F.when(compared, word_tokens(F.col("text"))).otherwise(none).alias("tokens_a"),
        F.when(compared, word_tokens(F.col("representative_text"))).otherwise(none).alias("tokens_b"), "has_texts", "n_docs")
    assert v.reports.dtypes == want.dtypes and sorted(v.reports.collect(), key=str) == sorted(want.collect(), key=str)
    assert sorted(v.core.collect(), key=str) == sorted(v.hub_tokens.collect(), key=str)
    assert "words" in v.__dict__  # found once, for the pairs and the core
