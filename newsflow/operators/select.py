"""Candidate pool, phrase blocklist, tiered batches, ranking and the winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.text import blank_to_null, contains_any, is_weekday, json_ranks
from newsflow.operators import phrases as phrases_of
from newsflow.params import Params


def _now(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.col(as_of) if isinstance(as_of, str) else F.lit(as_of)


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL {int(n * 3600)} SECOND")


def fresh_articles(feeds: list[DataFrame], as_of, max_age_hours: float) -> DataFrame:
    """All feeds together, cut at the maximum publish age."""
    rows = feeds[0]
    for feed in feeds[1:]:
        rows = rows.unionByName(feed)
    return rows.filter(F.col("published_at") >= _now(as_of) - hours(max_age_hours))


def pool_row(scored: DataFrame, stored_chars: int | None = None) -> DataFrame:
    """Rows as the candidate pool stores them: first-seen filled, not sent, text cut only if a limit is given."""
    cut_text = lambda c: (F.col(c) if stored_chars is None else F.substring(F.col(c), 1, stored_chars)).alias(c)
    return scored.select(
        "article_id", "seq", cut_text("title"), "url", "url_hash", cut_text("source_name"), cut_text("description"),
        "published_at", "score", cut_text("score_comment"), "heat_score",
        F.coalesce("event_first_seen_at", "published_at").alias("event_first_seen_at"),
    )


def pool_unsent(pool: DataFrame, send_log: DataFrame) -> DataFrame:
    """The pool without rows whose send flag was flipped; flags live in an append-only log."""
    return pool.join(send_log.select("article_id").distinct(), "article_id", "left_anti")


def pool_eligible(pool: DataFrame, as_of, max_age_hours: float, score_floor: float) -> DataFrame:
    """Created strictly inside the window and scored high enough, missing values filled."""
    return pool.filter(
        (F.col("created_at") > _now(as_of) - hours(max_age_hours)) & (F.col("score") >= score_floor)
    ).withColumns({
        "published_at": F.coalesce("published_at", "created_at"),
        "heat_score": F.coalesce(F.nullif("heat_score", F.lit(0.0)), F.lit(1.0)),
    })


def without_phrases(rows: DataFrame, columns: list[str], phrases) -> DataFrame:
    """Drop rows whose lower-cased columns, joined by blanks, contain a phrase.

    `phrases` is a tuple of parameters, which becomes one expression, or a table with a `phrase` column: tables of a
    checked size become automata that read each text once, larger ones are joined on the first letters of each phrase.
    Either is lower-cased.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    if isinstance(phrases, DataFrame):
        return _without_phrase_table(rows, text, phrases.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct())
    return rows.filter(~contains_any(text, tuple(p.lower() for p in phrases)))


def _without_phrase_table(rows: DataFrame, text: Column, table: DataFrame) -> DataFrame:
    of = phrases_of.shards(table)
    if not of:
        return _without_joined_phrases(rows, text, table)
    for shard in range(of):
        rows = rows.filter(~phrases_of.holds_any(text, table, shard, of))
    return rows


def _without_joined_phrases(rows: DataFrame, text: Column, table: DataFrame) -> DataFrame:
    size = table.agg(F.min(F.length("phrase"))).first()[0]
    if size is None:
        return rows
    heads = table.withColumn("head", F.substring("phrase", 1, size))
    marked = rows.withColumn("row_text", text).withColumn("row_key", F.sha2("row_text", 256))
    grams = F.array_distinct(F.regexp_extract_all("row_text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    # Grams travel with the key of their text only; the text itself is read again to check a match.
    maybe = marked.select("row_key", F.explode(grams).alias("head")).join(heads, "head").select("row_key", "phrase")
    hit = (
        marked.select("row_key", "row_text").join(maybe.distinct(), "row_key")
        .filter(F.contains("row_text", "phrase")).select("row_key").distinct()
    )
    return marked.join(hit, "row_key", "left_anti").drop("row_text", "row_key")


def tiered_batch(pool: DataFrame, as_of, params: Params, keys: list[str] = ()) -> DataFrame:
    """Up to batch_max rows per key by tier, score and order; the newest rows if too few qualify.

    Each answer is a top-k over a whole key, which Spark cuts to k rows per task before the shuffle.
    """
    now = _now(as_of)
    keys = list(keys) or ["_all"]
    rows = pool if keys != ["_all"] else pool.withColumn("_all", F.lit(0))
    weekday = is_weekday(now, params.calendar_zone)
    floor = F.when(weekday, params.weekday_floor).otherwise(params.weekend_floor)
    fresh = F.unix_micros(now) - F.unix_micros("published_at") <= int(params.fresh_hours * 3_600_000_000)
    score = F.col("score")
    tier = (
        F.when(fresh & (score >= params.top_tier_score), 1)
        .when(fresh & (score >= floor) & (score < params.top_tier_score), 2)
        .when(score >= floor, 3)
        .when(weekday & (score >= params.weekend_floor) & (score < floor), 4)
    )
    by_tier = Window.partitionBy(*keys).orderBy("tier", F.col("score").desc(), "seq")
    best = (
        rows.withColumn("tier", tier).filter("tier IS NOT NULL")
        .withColumn("batch_rank", F.row_number().over(by_tier))
        .filter(F.col("batch_rank") <= params.batch_max)
    )
    by_age = Window.partitionBy(*keys).orderBy(F.col("published_at").desc(), F.col("score").desc(), "seq")
    newest = (
        rows.withColumn("tier", F.lit(5)).withColumn("batch_rank", F.row_number().over(by_age))
        .filter(F.col("batch_rank") <= params.batch_min)
    )
    filled = best.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= params.batch_min).select(*keys)
    out = best.join(filled, keys, "left_semi").unionByName(newest.join(filled, keys, "left_anti"))
    return out.drop("_all")


def parsed_ranks(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ranked story; the retry answer is read only when the first one is malformed."""
    ranks = F.coalesce(json_ranks(F.col("rank_raw")), json_ranks(F.col("rank_retry_raw")))
    last = F.struct("pos", "priority_score")
    return (
        raw.select(*keys, F.posexplode(ranks).alias("pos", "r"))
        .select(*keys, "pos", F.col("r.id").alias("story_id"), F.col("r.priority_score").alias("priority_score"))
        .groupBy(*keys, "story_id").agg(F.max(last)["priority_score"].alias("priority_score"))
    )


def priority_rank(batch: DataFrame, raw: DataFrame, keys: list[str], id_col: str = "article_id") -> DataFrame:
    """Order by parsed priority, then publish time; by score when no answer could be read."""
    readable = raw.filter(
        F.coalesce(json_ranks(F.col("rank_raw")), json_ranks(F.col("rank_retry_raw"))).isNotNull()
    ).select(*keys, F.lit(True).alias("readable")).distinct()
    ranks = parsed_ranks(raw, keys)
    rows = (
        batch.withColumn("story_id", F.col(id_col).cast("string"))
        .join(ranks, [*keys, "story_id"], "left").drop("story_id")
        .join(readable, keys, "left")
        .withColumn("priority_score", F.coalesce("priority_score", F.lit(0.0)))
    )
    order = Window.partitionBy(*keys).orderBy(
        F.when(F.col("readable"), F.col("priority_score")).otherwise(F.col("score")).desc(),
        F.when(F.col("readable"), F.unix_micros("published_at")).desc(),
        "batch_rank",
    )
    return rows.withColumn("rank", F.row_number().over(order)).drop("readable")


def publish_winner(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """First row in rank order that is no repeat; a key whose rows are all repeats gives nothing."""
    best = Window.partitionBy(*keys).orderBy("rank")
    return (
        ranked.filter(~F.col("is_repeat")).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    )


def published_guard(matches: DataFrame, events: DataFrame, floor: float) -> DataFrame:
    """Clusters that do not repeat an already published event almost word for word."""
    published = events.filter("published").select(F.col("event_id").alias("matched_event_id"))
    rehash = (
        matches.filter(F.col("matched_cosine") >= floor)
        .join(published, "matched_event_id", "left_semi")
        .select("cluster_id").distinct()
    )
    return matches.join(rehash, "cluster_id", "left_anti")


def export_record(rows: DataFrame) -> DataFrame:
    """Nested post record as JSON; blank preview fields are left out."""
    data = F.struct(
        F.lit("post").alias("_t"),
        F.struct(F.lit("acl").alias("_t")).alias("acl"),
        F.col("post_text").alias("txt"),
        F.unix_millis("as_of").alias("udate"),
        F.unix_millis("as_of").alias("cdate"),
        F.col("user_id").alias("uid"),
        blank_to_null(F.col("preview_description")).alias("dsc"),
        blank_to_null(F.col("preview_image")).alias("previmg"),
        blank_to_null(F.col("preview_url")).alias("prevsrc"),
        blank_to_null(F.col("preview_title")).alias("ttl"),
    )
    return rows.select("article_id", F.to_json(F.struct(data.alias("data"), F.lit("post").alias("serial"))).alias("record"))


def trending_topn(entries: DataFrame, limit: int, keys: list[str] = ()) -> DataFrame:
    """First entries of a feed, then without blank titles (blank ones use up a place)."""
    keys = list(keys) or ["_all"]
    rows = entries if keys != ["_all"] else entries.withColumn("_all", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("position")
    return (
        rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        .filter("title <> ''").drop("_all")
    )


def domain_source(articles: DataFrame, sources: DataFrame, host_col: Column, suffixes: Column) -> DataFrame:
    """First source, in source order, whose domain equals the host or is a true parent of it."""
    hosts = articles.select(host_col.alias("host")).distinct()
    domains = sources.filter("domain <> ''").select("domain", "source_id", "source_order")
    first = domains.groupBy("domain").agg(F.min(F.struct("source_order", "source_id")).alias("s"))
    matched = (
        hosts.select("host", F.explode(suffixes).alias("domain")).join(first, "domain")
        .groupBy("host").agg(F.min("s")["source_id"].alias("matched_source"))
    )
    return articles.withColumn("host", host_col).join(matched, "host", "left")
