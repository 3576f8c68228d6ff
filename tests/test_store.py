from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from newsflow.operators import evidence, pages
from newsflow.params import Params
from newsflow.plans import ingest
from newsflow.sources.tables import SCHEMAS, Tables

T0 = datetime(2024, 5, 1)


def test_jobs_share_one_clock_and_never_overwrite_each_other(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    minute = 60_000_000
    cycles = []
    for number in range(3):
        cycles.append(tables.claim_cycle("ingest a", number, 1000 * minute + number * 10 * minute))
        point = F.from_json(F.lit(f'{{"point_id": {number}, "event_id": "e{number}"}}'), SCHEMAS["event_points"])
        tables.write("event_points", spark.range(1).select(point.alias("p")).select("p.*"), cycles[-1])
    assert cycles == sorted(set(cycles))
    publish = tables.claim_cycle("publish a", 0, 1030 * minute)
    assert {r.event_id for r in tables.read("event_points", publish).collect()} == {"e0", "e1", "e2"}
    # A batch that is run again has its cycle, a job with a new checkpoint has new ones, also for an older clock.
    assert tables.claim_cycle("ingest a", 2, 7) == cycles[2]
    assert tables.claim_cycle("ingest b", 0, 1000 * minute) > publish
    assert tables.claim_cycle("publish a", 0, 9999 * minute) == publish


def test_attributes_in_any_order_and_quotes(spark):
    html = """<meta content='a "b"' property=og:title><META NAME="twitter:title" content=other>
        <meta data-content="no" name='og:description' content="it's x=y"><meta property="og:url" content="u1" content="u2">
        <script type=x id='__NEXT_DATA__'>{"props":{"pageProps":{"image":"https://n/1.png"}}}</script>"""
    image = "<img alt='src=http://no/1.png' data-src='http://no/2.png' src=http://yes/3.png>"
    rows = spark.createDataFrame([(1, "u", html), (2, "u", image), (3, "u", None), (4, "u", "<meta <img src=")], "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.page_image(pages.page_meta(rows, 0.2)).collect()}
    assert (got[1].preview_title, got[1].preview_description, got[1].preview_url) == ('a "b"', "it's x=y", "u2")
    assert [got[i].preview_image for i in (1, 2, 3, 4)] == ["https://n/1.png", "http://yes/3.png", None, None]


def test_page_fetched_twice_does_not_double_its_article(spark):
    articles = spark.createDataFrame([("u", ""), ("v", "own"), ("w", None)], "url string, description string")
    meta = spark.createDataFrame([("u", None), ("u", "found"), ("u", "found"), ("v", "x"), ("v", "y")], "url string, preview_description string")
    got = sorted((r.url, r.description) for r in pages.description_backfill(articles, meta).collect())
    assert got == [("u", "found"), ("v", "own"), ("w", "")]


def test_funnel_counts_claims_inside_their_time_only(spark):
    rows = spark.createDataFrame(
        [(n, f"http://x/{n}", "t", "", "en", T0, T0, 9.0, n) for n in range(3)],
        "batch long, url string, title string, description string, lang string, published_at timestamp, as_of timestamp, score double, seq long",
    ).withColumn("batch", F.lit(0))
    keyed = [ingest.url_hash(F.lit(f"http://x/{n}")) for n in range(2)]
    claims = spark.range(1).select(F.explode(F.array(
        F.struct(keyed[0].alias("url_hash"), F.lit(T0 - timedelta(days=9)).alias("claimed_at")),
        F.struct(keyed[1].alias("url_hash"), F.lit(T0 - timedelta(days=11)).alias("claimed_at")),
    )).alias("c")).select("c.*")
    got = ingest.funnel_report(rows, claims, "as_of", Params(), ["batch"]).first()
    assert (got.n_raw, got.n_new) == (3, 2)


def points(spark, ids, at=T0):
    rows = [(i, f"e{i % 3}", "s", f"u{i}", at, [1.0]) for i in ids]
    return spark.createDataFrame(rows, SCHEMAS["event_points"])


def test_reader_sees_all_tables_of_a_cycle_or_none(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    sources = lambda *names: spark.createDataFrame([("e", n) for n in names], SCHEMAS["event_sources"])
    tables.commit(1, {"event_points": points(spark, [1, 2]), "event_sources": sources("a")})
    broken = spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("event_id"), F.lit("x").alias("source_name"))
    state = lambda: (Tables(spark, str(tmp_path)).read("event_points").count(), Tables(spark, str(tmp_path)).read("event_sources").count())
    with pytest.raises(Exception, match="lost"):
        tables.commit(2, {"event_points": points(spark, [3]), "event_sources": broken})
    assert state() == (2, 1)
    tables.commit(2, {"event_points": points(spark, [3]), "event_sources": sources("b", "c")})
    assert state() == (3, 3)
    # The cycle again: it replaces itself, a reader that began before sees what it saw.
    early = Tables(spark, str(tmp_path))
    assert early.read("event_sources").count() == 3
    tables.commit(2, {"event_points": points(spark, [3, 4]), "event_sources": sources("d")})
    assert early.read("event_sources").count() == 3 and state() == (4, 2)
    assert Tables(spark, str(tmp_path)).read("event_points", 2).count() == 2
    # The folders of the attempt that failed, and those of the cycle's first run.
    assert Tables(spark, str(tmp_path)).vacuum() == 4 and state() == (4, 2)


def test_compacted_tables_answer_alike(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    blank = {c: F.lit("") for c in "representative_text canonical_title canonical_summary event_type canonical_action actor target".split()}
    for cycle in range(1, 7):
        rows = [(f"e{i}", float(cycle), T0, T0) for i in range(cycle % 3, 6)]
        events = spark.createDataFrame(rows, "event_id string, heat_score double, first_seen_at timestamp, last_updated_at timestamp").withColumns(blank)
        tokens = spark.createDataFrame([(f"e{cycle % 2}", "t", cycle, cycle == 3), ("e1", f"t{cycle}", 1, False)], SCHEMAS["event_tokens"])
        flags = spark.createDataFrame([("e2", T0 + timedelta(hours=cycle))], SCHEMAS["event_flags"])
        tables.commit(cycle, {"events": events, "event_tokens": tokens, "event_flags": flags})
    def state():
        now = Tables(spark, str(tmp_path))
        core = now.read("event_tokens").groupBy("event_id", "token").agg(F.sum("df"), F.bool_or("is_seed"))
        return sorted(map(tuple, now.events().collect())), sorted(map(tuple, core.collect()))
    before = state()
    for name in ("events", "event_tokens", "event_flags"):
        tables.compact(name, 4)
        assert len(tables.folders(name)) == 3
    assert state() == before
    assert Tables(spark, str(tmp_path)).vacuum() == 12 and state() == before
    tables.compact("events", 6)
    assert state() == before and len(tables.folders("events")) == 1


def test_retention_drops_folders_and_rewrites_the_rest(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    for cycle, days in enumerate((30, 20, 10, 0)):
        rows = points(spark, [10 * cycle], T0 - timedelta(days=days)).unionByName(points(spark, [10 * cycle + 1], T0 - timedelta(days=days - 6)))
        tables.commit(cycle, {"event_points": rows})
    tables.expire("event_points", T0 - timedelta(days=17))
    left = lambda: sorted(r.point_id for r in Tables(spark, str(tmp_path)).read("event_points").collect())
    assert left() == [11, 20, 21, 30, 31] and {e.cycle for e in tables.folders("event_points")} == {1, 2, 3}
    files = lambda: len(list(tmp_path.glob("event_points/*")))
    assert files() == 5 and Tables(spark, str(tmp_path)).vacuum() == 2 and files() == 3 and left() == [11, 20, 21, 30, 31]
    tables.compact("event_points", 2)
    tables.expire("event_points", T0 - timedelta(days=9))
    assert left() == [21, 30, 31]
    tables.expire("event_points", T0 + timedelta(days=99))
    assert left() == [] and Tables(spark, str(tmp_path)).vacuum() > 0
    tables.expire("event_points", T0)


def test_hub_scores_by_increments_equal_a_full_count(spark, tmp_path):
    import random

    rng, tables = random.Random(9), Tables(spark, str(tmp_path))
    for cycle in range(20):
        core = spark.createDataFrame({(f"t{int(rng.paretovariate(0.8)) % 40}", f"e{rng.randrange(6 * cycle, 6 * cycle + 12)}") for _ in range(25)}, "token string, event_id string")
        credits = evidence.hub_bump(core, tables.read("hub_tokens"))
        rows = spark.createDataFrame(credits.collect(), credits.schema)
        tables.commit(cycle, {"hub_tokens": rows, "hub_counts": evidence.hub_counts(rows)})
        if cycle in (7, 15):
            tables.compact("hub_counts", cycle - 3)
    credits, counts = tables.read("hub_tokens"), tables.read("hub_counts")
    asked = spark.createDataFrame([(f"t{n}",) for n in range(0, 40, 3)], "token string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    full = evidence.hub_token_score(credits).join(asked, "token", "left_semi")
    assert as_set(evidence.token_scores(counts, asked)) == as_set(full) and full.count() > 5
    pairs = spark.createDataFrame([(f"t{a}", f"t{b}") for a in range(12) for b in range(a)], "token_a string, token_b string")
    assert as_set(evidence.hub_pair_score(pairs, credits, counts)) == as_set(evidence.hub_pair_score(pairs, credits))
