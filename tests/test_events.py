"""Event evidence, identity, heat, state and whole cycles."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import evidence, heat, simjoin, state
from newsflow.params import Params
from newsflow.plans import ingest
from newsflow.sources.tables import Tables

T0 = datetime(2024, 1, 3, 17, 0)
MAJOR = ("Reuters",)


def unit(cos):
    return [cos, (1 - cos * cos) ** 0.5]


def test_many_points_hide_other_events(spark):
    query = spark.createDataFrame([(1, [1.0, 0.0])], "article_id long, embedding array<double>")
    rows = [(n, "big", unit(0.95 - n * 0.001), T0) for n in range(8)] + [(50, "far", unit(0.7), T0), (51, "old", [1.0, 0.0], T0 - timedelta(hours=241))]
    points = spark.createDataFrame(rows, "point_id long, event_id string, embedding array<double>, last_updated_at timestamp")
    near = lambda k: evidence.event_topk(
        simjoin.nearest_points(query, points, 4 * k, 0.6, "last_updated_at", T0, 240, block_rows=3), points, k)
    assert [r.event_id for r in near(2).collect()] == ["big"]
    assert [(r.event_id, r.rank) for r in near(3).orderBy("rank").collect()] == [("big", 1), ("far", 2)]


CASES = {  # new tokens, core tokens -> verdict
    "rare": (["solo", "hub"], ["solo", "hub"], "COMPATIBLE"),
    "one_hub": (["hub"], ["hub"], "AMBIGUOUS"),
    "rare_pair": (["hub", "hub2"], ["hub", "hub2"], "COMPATIBLE"),
    "hub_pair": (["hub", "hub3"], ["hub", "hub3"], "AMBIGUOUS"),
    "none": (["x"], ["hub"], "NO_OVERLAP"),
    "no_core": (["x"], [], "COMPATIBLE"),
}


def test_identity_rules(spark):
    hubs = [("solo", "e_rare"), ("hub", "o1"), ("hub", "o2"), ("hub2", "o3"), ("hub2", "o4"), ("hub3", "o1"), ("hub3", "o2")]
    hub_tokens = spark.createDataFrame(hubs, "token string, event_id string")
    core = spark.createDataFrame([(name, t) for name, (_, c, _) in CASES.items() for t in c], "event_id string, token string")
    rows = [(1, n, name, new, ["a"], ["a"], True, 2) for n, (name, (new, _, _)) in enumerate(CASES.items())]
    rows += [(1, 90, "e1", [], ["a", "b"], ["a", "b"], True, 9), (1, 91, "e1", [], ["a"], ["b"], True, 9), (1, 92, "e1", [], [], [], False, 9)]
    candidates = spark.createDataFrame(
        rows, "batch_id long, cluster_id long, event_id string, new_tokens array<string>, tokens_a array<string>, "
        "tokens_b array<string>, has_texts boolean, n_docs long")
    freq = spark.createDataFrame([(1, "a", 2), (1, "b", 2)], "batch_id long, token string, df long")
    got = {r.cluster_id: r.rule_verdict for r in evidence.identity_verdict(candidates, core, hub_tokens, freq).collect()}
    want = {n: v for n, (_, _, v) in enumerate(CASES.values())} | {90: "COMPATIBLE", 91: "AMBIGUOUS", 92: "FAIL_OPEN"}
    assert got == want


def test_walk_stops_at_first_accepted(spark):
    rows = [(1, "a", 1, 0.9, "AMBIGUOUS", False, 1.0), (1, "b", 2, 0.8, "COMPATIBLE", True, 1.5), (1, "c", 3, 0.7, "COMPATIBLE", True, 0.2),
            (2, "a", 1, 0.9, "AMBIGUOUS", False, 1.0), (2, "b", 2, 0.8, "NO_OVERLAP", False, 1.0)]
    judged = spark.createDataFrame(rows, "cluster_id long, event_id string, rank int, cosine double, rule_verdict string, accepted boolean, multiplier double")
    judged = judged.withColumn("final_verdict", F.when(F.col("accepted"), "SAME_OCCURRENCE").when(
        F.col("rule_verdict") == "AMBIGUOUS", "RELATED_DIFFERENT_EVENT").otherwise("UNRELATED"))
    got = {r.cluster_id: r for r in evidence.identity_walk(judged).collect()}
    assert (got[1].matched_event_id, got[1].multiplier, got[1].related_links) == ("b", 1.5, [])
    assert got[2].matched_event_id is None and [x.event_id for x in got[2].related_links] == ["a"]
    assert evidence.decisions_before_accept(judged).filter("cluster_id = 1").count() == 2


def test_heat(spark):
    df = spark.createDataFrame([(["Reuters", "b", "c"], "c", ["b"])], "s array<string>, e string, old array<string>")
    row = df.select(
        heat.heat_new_event(F.col("s"), F.col("e"), MAJOR, 2.0).alias("n"),
        heat.heat_new_event(F.col("s"), F.lit("Reuters"), MAJOR, 2.0).alias("m"),
        heat.heat_update(F.lit(3.0), F.col("s"), F.col("old"), F.lit(1.5), MAJOR, 2.0).alias("u"),
    ).first()
    assert (row.n, row.m, row.u) == (4.0, 3.0, 7.5)


ARTICLE = "article_id long, seq long, url string, source_name string, title string, description string, published_at timestamp, lang string, embedding array<float>"


def empty_inputs(spark, scores):
    return ingest.Inputs(
        scores=spark.createDataFrame(scores, "article_id long, score_raw string, score_retry_raw string"),
        verdicts=spark.createDataFrame([], "cluster_id long, event_id string, same_raw string, subtype_raw string"),
        patterns=spark.createDataFrame([("Ann Lee", "PERSON"), ("Bob Stone", "PERSON")], "pattern string, label string"),
        verbs=spark.createDataFrame([("arrest", "arrest")], "verb string, event_type string"),
    )


def score(n, value):
    return (n, f'{{"llm_score": {value}, "llm_comment": "c"}}', None)


def article(n, source, minutes, vector, title="Ann Lee arrested in the city today"):
    return (n, n, f"https://x.com/{n}", source, title, f"description {n}", T0 - timedelta(minutes=minutes), "en", vector)


def test_cycles_end_to_end(spark, tmp_path):
    """One passes, one of its cluster fails, one near-duplicate, one unrelated; then the event continues."""
    tables, params = Tables(spark, str(tmp_path)), Params()
    first = spark.createDataFrame([
        article(1, "a", 30, [1.0, 0.0, 0.0]), article(2, "Reuters", 40, [0.7, 0.714, 0.0]),
        article(3, "b", 20, [0.99, 0.1, 0.0]), article(4, "c", 10, [0.0, 0.0, 1.0], "Something else entirely happened here"),
        article(5, "d", 300, [0.0, 1.0, 0.0]),
    ], ARTICLE)
    inputs = empty_inputs(spark, [score(1, 8), score(2, 3), score(3, 9), score(4, 2)])
    pool = ingest.run(tables, first, 1, T0, inputs, params).collect()
    # sources a, b and Reuters (earliest, so unweighted): 1 + 1 + 1
    assert [(r.article_id, r.heat_score, r.event_first_seen_at) for r in pool] == [(1, 3.0, T0 - timedelta(minutes=40))]
    event = tables.events().collect()
    assert len(event) == 1 and (event[0].event_type, event[0].actor) == ("arrest", "Ann Lee")
    assert {r.source_name for r in tables.read("event_sources").collect()} == {"a", "b", "Reuters"}

    later = T0 + timedelta(hours=1)
    second = spark.createDataFrame([article(11, "b", -40, [0.75, 0.0, 0.6614]), article(12, "Reuters", -45, [0.74, 0.1, 0.665]),
                                    article(13, "e", -41, [1.0, 0.0, 0.0])], ARTICLE)
    inputs = empty_inputs(spark, [score(11, 8), score(12, 8), score(13, 9)])
    pool = ingest.run(tables, second, 2, later, inputs, params).collect()
    # 13 repeats article 1 of the history; it still counts as a new source of the event
    assert [(r.article_id, r.heat_score) for r in pool] == [(11, 4.0)]
    assert tables.read("events").count() == 2 and tables.events().count() == 1
    assert tables.events().first().canonical_title == event[0].canonical_title
    before = {name: tables.read(name).count() for name in ("events", "event_points", "event_tokens", "hub_tokens", "pool", "url_claims")}
    ingest.run(tables, second, 2, later, inputs, params)
    assert before == {name: tables.read(name).count() for name in before}


def test_two_clusters_continue_one_event(spark):
    clusters = spark.createDataFrame(
        [(1, "e", 0.2, ["a", "n"], "a", T0, []), (2, "e", 1.5, ["n", "Reuters"], "n", T0 - timedelta(hours=3), [])],
        "cluster_id long, matched_event_id string, multiplier double, sources array<string>, earliest_source string, earliest_at timestamp, "
        "related_links array<struct<event_id:string,cosine:double>>")
    survivors = spark.createDataFrame(
        [(c, c, c, "u", f"h{c}", "n", T0, "t", "", f"text{c}", ["w"], [1.0], "x", None, None, None) for c in (1, 2)],
        "cluster_id long, seq long, article_id long, url string, url_hash string, source_name string, published_at timestamp, title string, "
        "description string, text string, entities array<string>, embedding array<float>, event_type string, action string, actor string, target string")
    names = "representative_text canonical_title canonical_summary event_type canonical_action actor target".split()
    events = spark.createDataFrame([("e", 2.0, T0 - timedelta(hours=1), T0, *["old"] * 7)],
                                   "event_id string, heat_score double, first_seen_at timestamp, last_updated_at timestamp, " + ", ".join(f"{n} string" for n in names))
    changes = state.event_commit(
        clusters, survivors, events, spark.createDataFrame([("e", "a")], "event_id string, source_name string"),
        spark.createDataFrame([("e", "v", 1, True)], "event_id string, token string, df long, is_seed boolean"),
        spark.createDataFrame([("v", "e")], "token string, event_id string"), F.lit(T0), F.lit(4), MAJOR, 2.0)
    row = changes["events"].first()
    assert row.heat_score == pytest.approx(2.0 + 0.2 * 1 + 1.5 * 2)
    assert (row.first_seen_at, row.representative_text, row.canonical_title) == (T0 - timedelta(hours=3), "text2", "old")
    assert [(r.token, r.event_id) for r in changes["hub_tokens"].collect()] == [("w", "e")]
    assert changes["event_points"].count() == 2


def test_preview_equals_commit_rule(spark):
    matches = spark.createDataFrame(
        [(1, "e", 1.5, ["a", "Reuters"], "a", T0), (2, None, 1.0, ["a", "Reuters"], "a", T0)],
        "cluster_id long, matched_event_id string, multiplier double, sources array<string>, earliest_source string, earliest_at timestamp")
    events = spark.createDataFrame([("e", 4.0, T0 - timedelta(hours=2))], "event_id string, heat_score double, first_seen_at timestamp")
    known = spark.createDataFrame([("e", "a")], "event_id string, source_name string")
    params = Params(major_outlets=MAJOR)
    got = {r.cluster_id: (r.heat_score, r.first_seen_at) for r in ingest.heat_preview(matches, events, known, params).collect()}
    assert got == {1: (7.0, T0 - timedelta(hours=2)), 2: (3.0, T0)}


def test_published_flag_is_kept_apart(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    blank = {c: F.lit("") for c in "representative_text canonical_title canonical_summary event_type canonical_action actor target".split()}
    for cycle, score in ((1, 1.0), (3, 2.0)):
        tables.write("events", spark.createDataFrame([("e", score, T0, T0)], "event_id string, heat_score double, first_seen_at timestamp, "
                     "last_updated_at timestamp").withColumns(blank), cycle)
    tables.write("event_flags", state.mark_published(spark.createDataFrame([("e",)], "event_id string"), F.lit(T0)), 2)
    row = lambda before: tables.events(before).select("heat_score", "published", "first_seen_at").first()
    assert tuple(row(2)) == (1.0, False, T0)
    assert tuple(row(3)) == (1.0, True, T0)
    assert tuple(row(4)) == (2.0, True, T0)


def test_block_size_does_not_change_nearest_points(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(n, [float(x) for x in rng.normal(size=8)], T0 - timedelta(hours=int(rng.integers(0, 100)))) for n in range(90)]
    points = spark.createDataFrame(rows, "point_id long, embedding array<double>, at timestamp")
    queries = spark.createDataFrame([(n, v, T0 - timedelta(hours=int(rng.integers(0, 60)))) for n, v, _ in rows[:40]],
                                    "article_id long, embedding array<double>, as_of timestamp")
    answers = []
    for size in (2048, 7):
        near = simjoin.nearest_points(queries, points, 4, 0.1, "at", "as_of", 24, block_rows=size)
        answers.append({(r.query_id, r.point_id, r["rank"]) for r in near.collect()})
    unit_of = {n: np.array(v) / np.linalg.norm(v) for n, v, _ in rows}
    plain = set()
    for q in queries.collect():
        seen = sorted((-round(float(unit_of[q.article_id] @ unit_of[n]), 12), n) for n, _, at in rows
                      if q.as_of - timedelta(hours=24) <= at < q.as_of)[:4]
        plain |= {(q.article_id, n, k + 1) for k, (c, n) in enumerate(seen) if -c >= 0.1}
    assert answers == [plain, plain]
