"""One ingest cycle: a pure function of the arriving articles and the state before the cycle.

Order: freshness, URL claim, language, description backfill, clustering, event match, history dedup,
score gate, event state, candidate pool. Every read of state happens before any write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.language import is_english
from newsflow.functions.text import compare_text, json_score, word_tokens
from newsflow.functions.urls import url_hash
from newsflow.operators import clustering, dedup, entities, evidence, pages, select, simjoin, state
from newsflow.operators.heat import heat_new_event, heat_update
from newsflow.params import Params
from newsflow.session import cut
from newsflow.sources.tables import Tables


@dataclass
class Inputs:
    """Outside answers of a cycle. `scores`: article_id, score_raw, score_retry_raw. `verdicts`:
    cluster_id, event_id, same_raw, subtype_raw, or a function that gives them for candidate rows.
    `patterns`: gazetteer. `verbs`: lexicon. `meta`: url, preview_description."""

    scores: DataFrame
    verdicts: DataFrame | Callable[[DataFrame], DataFrame]
    patterns: DataFrame
    verbs: DataFrame
    meta: DataFrame | None = None


def arrivals(articles: DataFrame, claims: DataFrame, as_of, params: Params) -> tuple[DataFrame, DataFrame]:
    """Fresh articles seen for the first time, and among them the English ones."""
    fresh = select.fresh_articles([articles], as_of, params.max_publish_age_hours)
    keyed = fresh.withColumn("url_hash", url_hash(F.col("url")))
    new = cut(dedup.url_dedup(keyed, claims, as_of, params.url_ttl_seconds))
    english = is_english(
        F.concat_ws(" ", "title", "description"), F.col("lang"), params.cjk_max, params.min_language_chars
    )
    return new, new.filter(english)


def match_events(
    reps: DataFrame, corpus: DataFrame, tables: Tables, cycle: int, as_of, inputs: Inputs, params: Params
) -> tuple[DataFrame, DataFrame]:
    """Candidate events per cluster, judged; and the walk's outcome per cluster."""
    events = tables.events(cycle)
    points = tables.read("event_points", cycle).select("point_id", "event_id", "embedding").join(
        events.select("event_id", "last_updated_at"), "event_id"
    )
    near = simjoin.nearest_points(
        reps, points, params.event_candidates * params.points_per_candidate, params.related_floor,
        at="last_updated_at", as_of=as_of, hours=params.event_hours, query_id="cluster_id",
        block_rows=params.block_rows,
    )
    top = evidence.event_topk(near, points, params.event_candidates).withColumnRenamed("query_id", "cluster_id")
    texts = events.select("event_id", "representative_text")
    tokens = entities.entity_tokens(reps, inputs.patterns, "cluster_id").groupBy("cluster_id").agg(
        F.collect_set("token").alias("new_tokens")
    )
    counted = evidence.doc_count(corpus, ["cycle"])
    no_tokens = F.array().cast("array<string>")
    candidates = cut(
        top.join(reps.select("cluster_id", "text", F.col("url")), "cluster_id")
        .join(tokens, "cluster_id", "left")
        .join(texts, "event_id")
        .select(
            F.lit(cycle).cast("bigint").alias("cycle"), "cluster_id", "event_id", "rank", "cosine",
            F.coalesce("new_tokens", no_tokens).alias("new_tokens"),
            word_tokens(F.col("text")).alias("tokens_a"),
            word_tokens(F.col("representative_text")).alias("tokens_b"),
            ((F.col("text") != "") & (F.col("representative_text") != "")).alias("has_texts"),
        )
        .join(counted, "cycle")
    )
    core = evidence.core_entities(
        tables.read("event_tokens", cycle).join(candidates.select("event_id").distinct(), "event_id", "left_semi"),
        params.core_doc_freq,
    )
    judged = evidence.identity_verdict(
        candidates, core, tables.read("hub_tokens", cycle), evidence.doc_freq(corpus, ["cycle"]),
        params.hub_events, params.pair_events_max, params.overlap_floor, keys=["cycle"], counts=tables.read("hub_counts", cycle),
    )
    verdicts = inputs.verdicts(candidates) if callable(inputs.verdicts) else inputs.verdicts
    decided = cut(evidence.verdict_join(judged, verdicts, {
        "CORE_UPDATE": params.core_update_weight,
        "CORROBORATION": params.corroboration_weight,
        "RESTATEMENT": params.restatement_weight,
    }))
    return decided, evidence.identity_walk(decided)


def run(
    tables: Tables, articles: DataFrame, cycle: int, as_of, inputs: Inputs, params: Params = Params()
) -> DataFrame:
    """Run the cycle, write its partitions and return the rows added to the candidate pool.

    `articles`: article_id, seq, url, source_name, title, description, published_at, lang, embedding.
    """
    now = F.lit(as_of)
    new, english = arrivals(articles, tables.read("url_claims", cycle), now, params)
    if inputs.meta is not None:
        english = pages.description_backfill(english, inputs.meta)
    survivors = cut(
        english.filter(F.col("embedding").isNotNull()).withColumns({
            "cycle": F.lit(cycle).cast("bigint"),
            "text": F.concat_ws("\n", "title", "description"),
        })
    )
    corpus = english.select(
        F.lit(cycle).cast("bigint").alias("cycle"), word_tokens(F.concat_ws(" ", "title", "description")).alias("tokens")
    )

    assigned = cut(clustering.greedy_clusters(
        survivors, params.duplicate_floor, params.related_floor, ["cycle"], "seq", params.block_rows
    ))
    placed = survivors.join(assigned, ["cycle", "seq"]).withColumnRenamed("cluster_seq", "cluster_id")
    summary = clustering.cluster_summary(placed.withColumnRenamed("cluster_id", "cluster_seq"), ["cycle"])
    members = placed.filter("role <> 'duplicate'")
    reps = placed.filter("role = 'seed'").select("cluster_id", "article_id", "url", "text", "embedding")

    decided, walked = match_events(reps, corpus, tables, cycle, as_of, inputs, params)
    matches = reps.select("cluster_id").join(walked, "cluster_id", "left").withColumns({
        "multiplier": F.coalesce("multiplier", F.lit(1.0)),
        "related_links": F.coalesce("related_links", F.array().cast("array<struct<event_id:string,cosine:double>>")),
    })
    events = tables.events(cycle)
    allowed = cut(select.published_guard(matches, events, params.duplicate_floor))
    clusters = summary.withColumnRenamed("cluster_seq", "cluster_id").join(allowed, "cluster_id")

    open_members = members.join(allowed.select("cluster_id"), "cluster_id", "left_semi")
    history = tables.read("article_vectors", cycle).withColumnRenamed("article_id", "point_id")
    checked = dedup.cross_cycle_dedup(
        open_members, history, params.duplicate_floor, as_of, params.history_hours, block_rows=params.block_rows
    ).filter("is_new")
    answer = F.coalesce(json_score(F.col("score_raw")), json_score(F.col("score_retry_raw")))
    scored = cut(
        checked.join(inputs.scores, "article_id").withColumn("a", answer).filter("a IS NOT NULL")
        .withColumns({"score": F.col("a.llm_score"), "score_comment": F.col("a.llm_comment")})
        .drop("a", "score_raw", "score_retry_raw")
    )
    passed = scored.filter(F.col("score") >= params.score_floor)
    gated = state.cluster_gate(clusters, scored, params.score_floor)

    tokens = entities.entity_tokens(passed, inputs.patterns, "article_id").groupBy("article_id").agg(
        F.collect_set("token").alias("entities")
    )
    frames = entities.event_frame(
        passed.withColumn("is_english", is_english(F.col("text"), F.col("lang"), params.cjk_max, params.min_language_chars)),
        inputs.patterns, inputs.verbs, "article_id",
    )
    full = cut(
        passed.join(tokens, "article_id", "left").join(frames, "article_id", "left")
        .withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    )
    changes = state.event_commit(
        gated, full, events, tables.read("event_sources", cycle), tables.read("event_tokens", cycle),
        tables.read("hub_tokens", cycle), now, F.lit(cycle), params.major_outlets, params.major_weight,
        params.core_doc_freq,
    )
    heat = changes.pop("assigned")
    changes["hub_tokens"] = cut(changes["hub_tokens"])
    changes["hub_counts"] = evidence.hub_counts(changes["hub_tokens"])
    pool = select.pool_row(
        full.join(heat, "cluster_id").withColumnRenamed("first_seen_at", "event_first_seen_at"), params.stored_chars
    ).withColumn("created_at", now)

    writes = {
        **changes,
        "pool": pool,
        "article_vectors": full.select(
            "article_id", "url", "url_hash",
            compare_text(F.col("title"), F.col("description"), params.compare_chars).alias("content"),
            "published_at", "embedding",
        ),
        "decisions": evidence.decisions_before_accept(decided).withColumn("logged_at", now),
        "url_claims": new.select("url_hash", now.alias("claimed_at")),
    }
    tables.commit(cycle, writes)
    return tables.read("pool").filter(F.col("cycle") == cycle)


def heat_preview(matches: DataFrame, events: DataFrame, event_sources: DataFrame, params: Params) -> DataFrame:
    """Heat and first-seen time a cluster would get, before anything is written.

    `matches`: cluster_id, matched_event_id, multiplier, sources, earliest_source, earliest_at.
    """
    credited = event_sources.groupBy("event_id").agg(F.collect_set("source_name").alias("credited"))
    known = events.select("event_id", "heat_score", "first_seen_at").join(credited, "event_id", "left").withColumnRenamed(
        "event_id", "matched_event_id"
    )
    rows = matches.join(known, "matched_event_id", "left")
    major = (params.major_outlets, params.major_weight)
    empty = F.array().cast("array<string>")
    return rows.select(
        "cluster_id",
        F.when(
            F.col("heat_score").isNotNull(),
            heat_update(F.col("heat_score"), F.col("sources"), F.coalesce("credited", empty), F.col("multiplier"), *major),
        ).otherwise(heat_new_event(F.col("sources"), F.col("earliest_source"), *major)).alias("heat_score"),
        F.least("first_seen_at", "earliest_at").alias("first_seen_at"),
    )


def funnel_report(
    articles: DataFrame, claims: DataFrame | None, as_of, params: Params, keys: list[str], english: Column | None = None
) -> DataFrame:
    """Rows per stage and key in one pass: how many articles each cheap filter leaves.

    `english` tells English articles where these come without their texts.
    """
    fresh = F.col("published_at") >= F.col(as_of) - select.hours(params.max_publish_age_hours)
    if english is None:
        english = is_english(
            F.concat_ws(" ", "title", "description"), F.col("lang"), params.cjk_max, params.min_language_chars
        )
    keyed = articles.withColumn("url_hash", url_hash(F.col("url"))).withColumn("is_fresh", fresh)
    per_url = keyed.groupBy(*keys, "url_hash").agg(
        F.max(as_of).alias("now"),
        F.count("*").alias("n"), F.count_if("is_fresh").alias("n_fresh"),
        F.min_by(english, F.when(F.col("is_fresh"), F.col("seq"))).alias("english"),
        F.min_by("score", F.when(F.col("is_fresh"), F.col("seq"))).alias("score"),
    )
    if claims is not None:
        latest = claims.groupBy("url_hash").agg(F.max("claimed_at").alias("claimed_at"))
        per_url = per_url.join(latest, "url_hash", "left")
    else:
        per_url = per_url.withColumn("claimed_at", F.lit(None).cast("timestamp"))
    ttl = F.expr(f"INTERVAL {int(params.url_ttl_seconds)} SECOND")
    live = F.coalesce(F.col("claimed_at") > F.col("now") - ttl, F.lit(False))
    kept = (F.col("n_fresh") > 0) & ~live
    return per_url.groupBy(*keys).agg(
        F.sum("n").alias("n_raw"), F.sum("n_fresh").alias("n_fresh"),
        F.count_if(kept).alias("n_new"),
        F.count_if(kept & F.col("english")).alias("n_english"),
        F.count_if(kept & F.col("english") & (F.col("score") >= params.score_floor)).alias("n_passed"),
    )
