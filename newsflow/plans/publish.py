"""One publish cycle: choose at most one item of the pool and record that it went out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.language import is_english
from newsflow.functions.text import is_declined, post_text, usable_text
from newsflow.functions.urls import url_hash
from newsflow.operators import dedup, pages, select, simjoin, state
from newsflow.params import Params
from newsflow.session import cut
from newsflow.sources.tables import Tables

KEY = ["cycle"]


@dataclass
class Inputs:
    """Outside answers. `texts`: url, page_text, detected. `generated`: article_id, generated.
    `ranks`: cycle, rank_raw, rank_retry_raw. `post_vectors`: article_id, embedding of the post without
    its url. `title_vectors`: article_id, embedding of title and description. `meta`: preview fields by url.
    `deliveries`: article_id of posts that really went out (None: all)."""

    texts: DataFrame
    generated: DataFrame
    ranks: DataFrame
    post_vectors: DataFrame
    title_vectors: DataFrame
    meta: DataFrame | None = None
    deliveries: DataFrame | None = None


def shortlist(pool: DataFrame, send_log: DataFrame, as_of, params: Params) -> DataFrame:
    unsent = select.pool_unsent(pool, send_log)
    eligible = select.pool_eligible(unsent, as_of, params.pool_hours, params.pool_score_floor)
    allowed = select.without_phrases(eligible, ["title", "description"], params.blocked_phrases)
    return select.tiered_batch(allowed, as_of, params)


def write_posts(batch: DataFrame, inputs: Inputs, params: Params) -> DataFrame:
    """Body text or description, English only, generated text attached; declined and blocked rows drop."""
    limit = params.language_chars
    judged = F.col("content") if limit is None else F.substring("content", 1, limit)
    with_text = (
        batch.join(pages.one_per_url(inputs.texts, "page_text", "detected"), "url", "left")
        .withColumn("content", F.coalesce(
            usable_text(F.col("page_text"), F.col("description"), params.min_text_chars, params.paywall_phrases),
            F.col("description"),
        ))
        .filter(is_english(
            judged, F.col("detected"), params.cjk_max, params.min_language_chars
        ))
    )
    posts = with_text.join(inputs.generated, "article_id").filter(~is_declined(F.col("generated"))).withColumn(
        "post_text", post_text(F.col("generated"), F.col("url"))
    )
    return select.without_phrases(posts, ["title", "description", "content", "post_text"], params.blocked_phrases)


def run(tables: Tables, cycle: int, as_of, inputs: Inputs, params: Params = Params()) -> DataFrame:
    """Choose the winner of the cycle, write its records and return the export record (0 or 1 row)."""
    now = F.lit(as_of)
    batch = cut(shortlist(tables.read("pool", cycle), tables.read("send_log", cycle), now, params))
    posts = write_posts(batch.drop("cycle"), inputs, params).withColumn("cycle", F.lit(cycle).cast("bigint"))
    ranked = select.priority_rank(posts, inputs.ranks, KEY)
    with_vectors = cut(ranked.join(inputs.post_vectors.select("article_id", "embedding"), "article_id"))
    checked = dedup.posted_dedup(
        with_vectors, tables.read("posted_history", cycle), params.posted_floor, as_of, params.posted_hours,
        block_rows=params.block_rows,
    )
    winner = cut(select.publish_winner(checked, KEY))
    if inputs.deliveries is not None:
        delivered = cut(winner.join(inputs.deliveries.select("article_id"), "article_id", "left_semi"))
    else:
        delivered = winner

    events = tables.events(cycle)
    points = tables.read("event_points", cycle).join(events.select("event_id", "last_updated_at"), "event_id")
    titles = delivered.select("article_id").join(inputs.title_vectors, "article_id")
    hit = simjoin.best_recent(
        titles, points, params.related_floor, at="last_updated_at", as_of=as_of, hours=params.event_hours,
        block_rows=params.block_rows,
    ).join(points.select("point_id", "event_id"), "point_id")

    writes = {
        "send_log": delivered.select("article_id", now.alias("sent_at")),
        "posted_history": delivered.select(
            F.col("article_id").alias("point_id"), "url", url_hash(F.col("url")).alias("url_hash"),
            F.col("post_text").alias("content"), "published_at", "embedding",
        ),
        "event_flags": state.mark_published(hit, now),
    }
    tables.commit(cycle, writes)
    return export(winner, inputs.meta, now)


def export(winner: DataFrame, meta: DataFrame | None, now) -> DataFrame:
    names = ["preview_title", "preview_description", "preview_image", "preview_url"]
    if meta is not None:
        rows = winner.join(pages.one_per_url(meta, *names), "url", "left")
    else:
        rows = winner.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    return select.export_record(rows.withColumns({
        "as_of": now, "user_id": F.lit("newsflow"),
        "preview_title": F.coalesce("preview_title", "title"),
        "preview_description": F.coalesce("preview_description", "description"),
        "preview_url": F.coalesce("preview_url", "url"),
    }))
