"""Claims, tiers, ranking and guards against plain statements of the rules."""

import random

import pytest
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from newsflow.operators import dedup, select
from newsflow.params import Params

T0 = datetime(2024, 1, 3, 17, 0)  # a Wednesday
WEEKEND = datetime(2024, 1, 6, 17, 0)


def claims(times, ttl):
    held, out = None, []
    for t in sorted(set(times)):
        if held is None or t >= held + ttl:
            held = t
            out.append(t)
    return out


@pytest.mark.parametrize("hot_times", [200_000, 20, 0])
def test_claims_do_not_extend(spark, hot_times):
    rng = random.Random(3)
    by_key = {"a": [0, 5, 9, 10, 12, 21, 31], "b": [7], None: [3, 4, 13, 40]}
    by_key |= {f"k{n}": [rng.randrange(0, 900) for _ in range(rng.randrange(1, 80))] for n in range(12)}
    by_key["gap"] = [0, 1, 500, 501, 511, 4000]
    rows = [(k, datetime.fromtimestamp(t, timezone.utc)) for k, ts in by_key.items() for t in ts]
    df = spark.createDataFrame(rows, "key string, at timestamp")
    got = dedup.claim_times(df.repartition(3), "key", "at", 10, hot_times).select("key", F.unix_seconds("claimed_at").alias("t"))
    expected = sorted((str(k), t) for k, ts in by_key.items() for t in claims(ts, 10))
    assert sorted((str(r.key), r.t) for r in got.collect()) == expected


def test_claims_go_on_across_batches(spark):
    """A key of many Arrow batches, between keys of one row each."""
    rows = spark.range(0, 30_000, 1, 4).selectExpr("CASE WHEN id % 100 = 7 THEN id ELSE -1 END AS key", "timestamp_seconds(id) AS at")
    got = dedup.claim_times(rows, "key", "at", 2_500).select("key", F.unix_seconds("claimed_at").alias("t")).collect()
    by_key = {}
    for i in range(30_000):
        by_key.setdefault(i if i % 100 == 7 else -1, []).append(i)
    assert sorted((r.key, r.t) for r in got) == sorted((k, t) for k, ts in by_key.items() for t in claims(ts, 2_500))


def test_url_claim_expires(spark):
    articles = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "seq long, url_hash string")
    held = spark.createDataFrame([("y", T0 - timedelta(days=9)), ("z", T0 - timedelta(days=10))], "url_hash string, claimed_at timestamp")
    got = dedup.url_dedup(articles, held, T0, 864_000)
    assert {r.seq for r in got.collect()} == {1, 4}


def test_undelivered_alert_does_not_restart_clock(spark):
    rows = [("s", T0, False), ("s", T0 + timedelta(hours=1), True), ("s", T0 + timedelta(hours=6.5), True),
            ("s", T0 + timedelta(hours=7), True), ("", T0, True)]
    df = spark.createDataFrame(rows, "source_id string, at timestamp, delivered boolean")
    got = [r.sent_at for r in dedup.alerts_to_send(df, 21_600).collect()]
    assert sorted(got) == [T0 + timedelta(hours=1), T0 + timedelta(hours=7)]


def plain_batch(rows, weekday, p):
    """rows: (id, score, age hours), already in pool order."""
    floor = p.weekday_floor if weekday else p.weekend_floor
    fresh = [r for r in rows if r[2] <= p.fresh_hours]
    picked = sorted([r for r in fresh if r[1] >= p.top_tier_score], key=lambda r: -r[1])
    tiers = [
        [r for r in fresh if floor <= r[1] < p.top_tier_score],
        [r for r in rows if r[1] >= floor],
        [r for r in rows if weekday and p.weekend_floor <= r[1] < floor],
    ]
    for tier in tiers:
        if len(picked) < p.batch_max:
            rest = sorted([r for r in tier if r not in picked], key=lambda r: -r[1])
            picked = picked + rest[: p.batch_max - len(picked)]
    if len(picked) < p.batch_min:
        picked = sorted(rows, key=lambda r: r[2])[: p.batch_min]
    return [r[0] for r in picked[: p.batch_max]]


def test_tiers(spark):
    rng, p = random.Random(11), Params()
    rows, want = [], {}
    for cycle in range(60):
        now = T0 if cycle % 2 else WEEKEND
        pool = [(n, rng.choice([4, 5, 5.5, 6, 6.5, 7, 8, 9.0]), rng.choice([0.5, 1, 3.9, 4, 4.5, 9, 11])) for n in range(rng.choice([0, 1, 2, 4, 9, 30]))]
        pool.sort(key=lambda r: -r[1])
        pool = [(n, s, a) for n, (_, s, a) in enumerate(pool)]
        want[cycle] = plain_batch(pool, now == T0, p)
        rows += [(cycle, now, n, float(s), now - timedelta(hours=a)) for n, s, a in pool]
    df = spark.createDataFrame(rows, "cycle long, as_of timestamp, seq long, score double, published_at timestamp")
    out = select.tiered_batch(df, "as_of", p, ["cycle"]).collect()
    got = {c: [r.seq for r in sorted((r for r in out if r.cycle == c), key=lambda r: r.batch_rank)] for c in want}
    assert got == want


def test_phrases_as_parameters_and_table_agree(spark):
    rows = spark.createDataFrame(
        [(1, "the Former President Trump said"), (2, "president trump"), (3, None), (4, "ab"), (5, "Zebra crossing")], "id int, title string")
    phrases = ("Former President Trump", "zebra")
    table = spark.createDataFrame([(p,) for p in (*phrases, "", None)], "phrase string")
    inline = {r.id for r in select.without_phrases(rows, ["title"], phrases).collect()}
    joined = {r.id for r in select.without_phrases(rows, ["title"], table).collect()}
    assert inline == joined == {2, 3, 4}
    assert select.without_phrases(rows, ["title"], table.limit(0)).count() == 5


@pytest.mark.parametrize("how", ["one automaton", "many automata", "join"])
def test_phrases_of_any_length(spark, monkeypatch, how):
    from newsflow.operators import phrases as phrases_of

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    listed = [word(n) for n in (1, 2, 3, 7, 30, 120, 500) for _ in range(6)]
    listed = [p for p in listed if p.strip() and (len(p) > 3 or "é" in p)] + ["Éa b", "日本", "a\nb"]
    texts = ["".join(rng.choice("bc xyz") for _ in range(60)) for _ in range(80)]
    for n, phrase in enumerate(listed):
        texts += ["xyz " + phrase + " z", "zz" + phrase[:-1], phrase.upper()][: 1 + n % 3]
    texts += ["", None, "y" * 30_000 + listed[-1]]
    monkeypatch.setattr(phrases_of, "SHARD_BYTES", 8 << 20 if how == "one automaton" else 2_000)
    monkeypatch.setattr(phrases_of, "TRAVEL_BYTES", -1 if how == "join" else 64 << 20)
    rows = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)], "id long, title string, phrase int")
    table = spark.createDataFrame([(p,) for p in listed] + [("",), (None,)], "phrase string")
    got = select.without_phrases(rows, ["title"], table)
    assert got.columns == rows.columns
    want = {n for n, t in enumerate(texts) if not any(p.lower() in (t or "").lower() for p in listed)}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(texts)
    if how != "join":
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_guard_drops_rehash_only(spark):
    matches = spark.createDataFrame(
        [(1, "e", 0.8), (2, "e", 0.79), (3, "f", 0.95), (4, None, None)],
        "cluster_id long, matched_event_id string, matched_cosine double")
    events = spark.createDataFrame([("e", True), ("f", False)], "event_id string, published boolean")
    assert {r.cluster_id for r in select.published_guard(matches, events, 0.8).collect()} == {2, 3, 4}


def vector_at(angle):
    import math

    return [math.cos(math.radians(angle)), math.sin(math.radians(angle))]


def test_posted_floor_is_strict(spark):
    import math

    at = [(1, [0.7, math.sqrt(1 - 0.49)]), (2, [0.71, math.sqrt(1 - 0.71**2)]), (3, [0.0, -1.0])]
    queries = spark.createDataFrame(at, "article_id long, embedding array<double>")
    posted = spark.createDataFrame([(9, "https://p", T0, [1.0, 0.0]), (8, "https://old", T0 - timedelta(days=11), [0.0, -1.0])],
                                   "point_id long, url string, published_at timestamp, embedding array<double>")
    rows = dedup.posted_dedup(queries, posted, 0.70, T0, 240).collect()
    assert {r.article_id: (r.is_repeat, r.matched_url) for r in rows} == {
        1: (False, "https://p"), 2: (True, "https://p"), 3: (False, "https://p")}


def test_domain_first_source_wins(spark):
    from newsflow.functions.urls import host, host_suffixes

    articles = spark.createDataFrame([(1, "https://a.ft.com/x"), (2, "https://joehoft.com/")], "id int, url string")
    sources = spark.createDataFrame([("s2", "ft.com", 2), ("s1", "a.ft.com", 3), ("s0", "", 1)], "source_id string, domain string, source_order int")
    got = select.domain_source(articles, sources, host(F.col("url")), host_suffixes(F.col("host")))
    assert {r.id: r.matched_source for r in got.collect()} == {1: "s2", 2: None}
