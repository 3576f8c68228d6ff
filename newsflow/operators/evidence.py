"""Token evidence and the identity rules: does a new report continue a known event?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.text import labelled_field, says_same
from newsflow.operators import postings
from newsflow.session import cut

COMPATIBLE, AMBIGUOUS, NO_OVERLAP, FAIL_OPEN = "COMPATIBLE", "AMBIGUOUS", "NO_OVERLAP", "FAIL_OPEN"


def doc_freq(documents: DataFrame, keys: list[str] = ("batch_id",)) -> DataFrame:
    """Documents per token inside each key; `documents` has keys and `tokens`.

    Counting holds every token that a task meets, so tasks get documents of a bounded size, however large the files are.
    Those of a key come together as far as they fit, which leaves fewer rows for the second count.
    """
    dealt = documents.select(*keys, "tokens", F.xxhash64(*keys).alias("at")).hint("rebalance", "at")
    return dealt.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(
        F.count("*").alias("df")
    )


def doc_count(documents: DataFrame, keys: list[str] = ("batch_id",)) -> DataFrame:
    return documents.groupBy(*keys).agg(F.count("*").alias("n_docs"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (F.coalesce(df, F.lit(0)) + 1))


def token_idf(documents: DataFrame, keys: list[str] = ("batch_id",)) -> DataFrame:
    frequencies = doc_freq(documents, keys)
    return frequencies.join(doc_count(documents, keys), list(keys)).select(
        *keys, "token", "df", idf(F.col("df"), F.col("n_docs")).alias("idf")
    )


def weighted_overlap(
    pairs: DataFrame, frequencies: DataFrame, pair_keys: list[str], keys: list[str] = ("batch_id",),
    block_docs: int = 16_384, block_pairs: int = 2_048,
) -> DataFrame:
    """IDF-weighted Jaccard of `tokens_a` and `tokens_b`; `pairs` also carries keys and `n_docs`.

    Tokens of pairs never become rows: the pairs of a key meet its frequencies in a task. A key of many documents is split by
    token, one of many pairs also by pair, so that a task holds a bounded part of it; sums of the parts are added up.
    """
    keys, grid = list(keys), [*keys, "pair_block", "token_block"]
    # Keys of more than one part: few rows, at most the pairs divided by the size of a block.
    parts = F.greatest(F.ceil(F.max("n_docs") / block_docs), F.lit(1))
    split = cut(
        pairs.groupBy(*keys).agg(F.count("*").alias("n"), parts.cast("int").alias("token_blocks"))
        .withColumn("pair_blocks", F.ceil(F.col("n") / (F.col("token_blocks") * block_pairs)).cast("int"))
        .filter("token_blocks > 1 OR pair_blocks > 1").drop("n")
    )
    blocks = ["token_blocks", "pair_blocks"]
    numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    block_of = lambda count, *of: F.pmod(F.xxhash64(*of), F.col(count)).cast("int")
    whole = F.col("tokens_a").isNotNull() & F.col("tokens_b").isNotNull()
    part = lambda tokens: F.when(whole & (F.col("token_blocks") == 1), F.col(tokens)).when(
        whole, F.filter(tokens, lambda t: block_of("token_blocks", t) == F.col("token_block"))
    )
    left = (
        pairs.select(*pair_keys, *keys, "n_docs", "tokens_a", "tokens_b").join(split, keys, "left").fillna(1, blocks)
        .withColumn("pair_block", block_of("pair_blocks", *pair_keys)).withColumn("token_block", numbers("token_blocks"))
        .select(*pair_keys, *grid, F.col("n_docs").cast("double").alias("n_docs"), part("tokens_a").alias("tokens_a"), part("tokens_b").alias("tokens_b"))
    )
    right = (
        frequencies.dropna(subset=[*keys, "token"]).join(split, keys, "left").fillna(1, blocks)
        .withColumn("token_block", block_of("token_blocks", "token")).withColumn("pair_block", numbers("pair_blocks"))
        .select(*[F.col(c).alias(c) for c in grid], F.col("token").alias("token"), F.coalesce("df", F.lit(0)).cast("double").alias("df"))
    )
    types = dict(pairs.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in pair_keys], "s double", "u double"])

    def body(mine: pa.Table, known: pa.Table) -> pa.Table:
        s, u = _overlap_sums(mine, known)
        return mine.select(pair_keys).append_column("s", pa.array(s)).append_column("u", pa.array(u))

    sums = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(body, schema)
    return sums.groupBy(*pair_keys).agg(F.sum("s").alias("s"), F.sum("u").alias("u")).select(
        *pair_keys, F.coalesce(F.try_divide("s", "u"), F.lit(0.0)).alias("overlap")
    )


def _overlap_sums(pairs: pa.Table, frequencies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the tokens that both sets of a pair have, and of those that either has, summed per pair."""
    n = pairs.num_rows
    if n == 0:
        return np.zeros(0), np.zeros(0)
    lists = [pairs.column(name).combine_chunks() for name in ("tokens_a", "tokens_b")]
    tokens = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
    names, width = tokens.dictionary, max(1, len(tokens.dictionary))
    code = pc.fill_null(tokens.indices, -1).to_numpy().astype(np.int64)
    row = np.concatenate([pc.list_parent_indices(c).to_numpy() for c in lists]).astype(np.int64)
    marks, ends = row * width + code, len(lists[0].flatten())
    first, second = (_runs(marks[side][code[side] >= 0])[0] for side in (slice(ends), slice(ends, None)))
    marks, many = _runs(np.concatenate([first, second]))
    # A token without a frequency counts as one of no documents, one with several as often as it has them.
    at = pc.fill_null(pc.index_in(frequencies.column("token"), value_set=names), -1).to_numpy().astype(np.int64)
    missing = np.flatnonzero(np.bincount(at + 1, minlength=len(names) + 1)[1:] == 0)
    df = np.concatenate([frequencies.column("df").to_numpy()[at >= 0], np.zeros(len(missing))])
    at = np.concatenate([at[at >= 0], missing])
    df, times = df[np.argsort(at, kind="stable")], np.bincount(at, minlength=width)
    row, token = np.divmod(marks, width)
    times, begin = times[token], (np.cumsum(times) - times)[token]
    row, shared, place = np.repeat(row, times), np.repeat(many == 2, times), np.repeat(begin - np.cumsum(times) + times, times)
    share = (pairs.column("n_docs").to_numpy()[row] + 1) / (df[place + np.arange(len(place))] + 1)
    weight = np.log(share, out=np.zeros(len(share)), where=share > 0)
    # Without any weight the sums of numpy are whole numbers.
    return np.bincount(row[shared], weight[shared], n).astype(float), np.bincount(row, weight, n).astype(float)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each comes."""
    values = np.sort(values)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[start], np.diff(np.append(start, len(values)))


def core_entities(event_tokens: DataFrame, min_docs: int = 2) -> DataFrame:
    """Identity tokens per event: its seed tokens and those found in enough of its own articles."""
    return (
        event_tokens.groupBy("event_id", "token")
        .agg(F.sum("df").alias("df"), F.bool_or("is_seed").alias("is_seed"))
        .filter(F.col("is_seed") | (F.col("df") >= min_docs))
        .select("event_id", "token")
    )


def hub_token_score(hub_tokens: DataFrame) -> DataFrame:
    """Distinct events each token has been a core token of."""
    return hub_tokens.select("token", "event_id").distinct().groupBy("token").agg(F.count("*").alias("score"))


def hub_counts(credits: DataFrame) -> DataFrame:
    """What a cycle's new credits add to the score of each token."""
    return credits.groupBy("token").agg(F.count("*").alias("n"))


def token_scores(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Scores of the given tokens, as sums of what each cycle added: the credits themselves are not counted again."""
    wanted = tokens.select("token").distinct()
    return counts.join(wanted, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("score"))


def hub_pair_score(pairs: DataFrame, hub_tokens: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Distinct events in which both tokens of an asked-for pair are core tokens.

    A pair of an event is a pair of its tokens, so pairs are looked up, not stored: a task counts the pairs of two blocks of
    tokens over the events of these. Only credits of asked-for tokens are read further.
    """
    asked = pairs.select(F.least("token_a", "token_b").alias("token_a"), F.greatest("token_a", "token_b").alias("token_b")).distinct()
    wanted = asked.select(F.explode(F.array("token_a", "token_b")).alias("token"))
    return postings.pair_counts(asked, hub_tokens, _known(wanted, counts))


def _known(wanted: DataFrame, counts: DataFrame | None) -> DataFrame:
    """The wanted tokens, those that `counts` knows, if given."""
    return wanted if counts is None else wanted.join(counts.select("token").distinct(), "token", "left_semi")


def hub_bump(core: DataFrame, hub_tokens: DataFrame) -> DataFrame:
    """Credits (token, event) that the hub table does not hold yet."""
    return core.select("token", "event_id").distinct().join(hub_tokens, ["token", "event_id"], "left_anti")


def identity_verdict(
    candidates: DataFrame, core: DataFrame, hub_tokens: DataFrame, frequencies: DataFrame | None,
    hub_events: int = 2, pair_events_max: int = 1, overlap_floor: float = 0.15, keys: list[str] = ("batch_id",),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Rule-tier verdict per (cluster_id, event_id). With `counts` (see `hub_counts`) scores are summed, not counted anew.

    `candidates` has keys, cluster_id, event_id, new_tokens, and for the fallback of reports without
    tokens tokens_a, tokens_b (new and representative text), has_texts and n_docs.
    """
    ident = ["cluster_id", "event_id"]
    tokens = candidates.select(*ident, F.explode("new_tokens").alias("token"))
    scores = hub_token_score(hub_tokens) if counts is None else token_scores(counts, core)
    # Scores go to the core tokens, of which there are fewer than shared ones.
    marked = core.join(scores, "token", "left").select("event_id", "token", (F.coalesce("score", F.lit(0)) < hub_events).alias("is_rare"))
    shared = tokens.join(marked, ["event_id", "token"]).groupBy(*ident).agg(
        F.count("*").alias("n_shared"), F.bool_or("is_rare").alias("has_rare"), F.collect_set(F.when(~F.col("is_rare"), F.col("token"))).alias("tokens"),
    )
    # Only pairs of reports whose shared tokens are all hubs are looked up, inside tasks: they are quadratic in a report's tokens.
    unsettled = ~F.col("has_rare") & (F.size("tokens") > 1)
    facts = cut(shared.withColumn("tokens", F.when(unsettled, F.col("tokens"))).withColumn("id", F.monotonically_increasing_id()))
    sets = facts.filter("tokens IS NOT NULL").select("id", "tokens")
    wanted = sets.select(F.explode("tokens").alias("token"))
    rare_pairs = postings.with_rare_pair(sets, hub_tokens, pair_events_max, _known(wanted, counts))
    facts = facts.drop("tokens").join(rare_pairs.withColumn("has_rare_pair", F.lit(True)), "id", "left").drop("id")
    known = core.select("event_id").distinct().withColumn("has_core", F.lit(True))
    # The size goes through the joins in place of the tokens, unless the caller reads these.
    rows = candidates.withColumn("n_new", F.size("new_tokens")).join(facts, ident, "left").join(known, "event_id", "left")
    if frequencies is None:
        lexical = F.lit(FAIL_OPEN)
    else:
        blank = candidates.filter((F.size("new_tokens") == 0) & F.col("has_texts"))
        # Frequencies of no other tokens travel on.
        asked = blank.select(*keys, F.explode(F.array_union("tokens_a", "tokens_b")).alias("token")).distinct()
        rows = rows.join(weighted_overlap(blank, frequencies.join(asked, [*keys, "token"], "left_semi"), ident, keys), ident, "left")
        lexical = (
            F.when(~F.col("has_texts"), FAIL_OPEN)
            .when(F.col("overlap") >= overlap_floor, COMPATIBLE)
            .otherwise(AMBIGUOUS)
        )
    verdict = (
        F.when(F.col("n_new") == 0, lexical)
        .when(F.col("has_core").isNull(), COMPATIBLE)
        .when(F.col("n_shared").isNull(), NO_OVERLAP)
        .when(F.col("has_rare") | F.coalesce("has_rare_pair", F.lit(False)), COMPATIBLE)
        .otherwise(AMBIGUOUS)
    )
    return rows.select(*candidates.columns, verdict.alias("rule_verdict"))


def verdict_join(candidates: DataFrame, verdicts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Attach outside verdicts: only ambiguous pairs ask whether it is the same event.

    `verdicts` has cluster_id, event_id, same_raw, subtype_raw; a missing row means "not the same".
    """
    rows = candidates.join(verdicts, ["cluster_id", "event_id"], "left")
    subtype = labelled_field(F.col("subtype_raw"), "SUBTYPE")
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(subtype == name, F.lit(float(value))).otherwise(weight)
    accepted = (
        F.when(F.col("rule_verdict") == NO_OVERLAP, False)
        .when(F.col("rule_verdict") == AMBIGUOUS, says_same(F.col("same_raw")))
        .otherwise(True)
    )
    final = (
        F.when(F.col("rule_verdict") == NO_OVERLAP, "UNRELATED")
        .when(accepted, "SAME_OCCURRENCE")
        .otherwise("RELATED_DIFFERENT_EVENT")
    )
    return rows.select(
        *candidates.columns, accepted.alias("accepted"), final.alias("final_verdict"),
        F.when(accepted, weight).otherwise(F.lit(1.0)).alias("multiplier"),
    )


def identity_walk(judged: DataFrame) -> DataFrame:
    """First accepted candidate per cluster by rank; related links only where none is accepted.

    At most a handful of candidates per cluster exist, so the link list is short by construction.
    """
    hit = F.col("accepted")
    link = F.struct(F.col("rank"), F.col("event_id"), F.col("cosine"))
    return judged.groupBy("cluster_id").agg(
        F.min_by(F.when(hit, F.col("event_id")), F.when(hit, F.col("rank"))).alias("matched_event_id"),
        F.min_by(F.when(hit, F.col("cosine")), F.when(hit, F.col("rank"))).alias("matched_cosine"),
        F.coalesce(
            F.min_by(F.when(hit, F.col("multiplier")), F.when(hit, F.col("rank"))), F.lit(1.0)
        ).alias("multiplier"),
        F.array_sort(
            F.collect_list(F.when(F.col("final_verdict") == "RELATED_DIFFERENT_EVENT", link))
        ).alias("l"),
    ).select(
        "cluster_id", "matched_event_id", "matched_cosine", "multiplier",
        F.when(F.col("matched_event_id").isNull(), F.transform("l", lambda x: F.struct(x["event_id"], x["cosine"])))
        .otherwise(F.array().cast("array<struct<event_id:string,cosine:double>>"))
        .alias("related_links"),
    )


def decisions_before_accept(judged: DataFrame) -> DataFrame:
    """The candidates a sequential walk would have looked at: up to the first accepted one."""
    stop = judged.filter("accepted").groupBy("cluster_id").agg(F.min("rank").alias("stop"))
    return judged.join(stop, "cluster_id", "left").filter("stop IS NULL OR rank <= stop").drop("stop")


def event_topk(points: DataFrame, point_events: DataFrame, k: int) -> DataFrame:
    """Distinct events among the nearest points: the best point of each, first k events.

    `points` is the answer of `nearest_points` (query_id, point_id, cosine, rank), already cut to the
    nearest 4k points; an event with many near points can therefore hide events farther away.
    """
    events = points.join(point_events.select("point_id", "event_id"), "point_id")
    best = events.groupBy("query_id", "event_id").agg(
        F.min("rank").alias("point_rank"), F.max("cosine").alias("cosine")
    )
    order = Window.partitionBy("query_id").orderBy("point_rank")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("point_rank")
