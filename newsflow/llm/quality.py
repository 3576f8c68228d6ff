"""Quality rules: a hashed n-gram likelihood ratio between trusted and raw text, beside plain counts.

Words and word pairs are hashed into a fixed number of slots. Two multinomials over the slots, one of documents
labelled good and one of all documents, give each slot a log ratio; a document's score is the mean ratio of its
n-grams, and a fixed threshold decides. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import texts_of


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    #: A document with more of its words in repeated windows than this, in per cent, fails.
    max_repeat_percent: int = 30
    #: Slots of the two multinomials; their log ratios are all that reaches the driver.
    slots: int = 1 << 14
    #: At most so many documents labelled good stand for trusted text, those with the smallest hashes of their ids.
    trusted_documents: int = 20_000
    #: Share of a slot's mean n-grams in the raw corpus below which it says nothing, and n-grams that it needs anyway.
    min_share: float = 0.02
    min_count: int = 20
    #: Share of the trusted n-grams by which their counts are drawn towards the raw corpus, and n-grams per slot at least.
    prior_share: float = 0.05
    prior: float = 4.0
    #: Mean log ratio in nats per n-gram below which a document goes.
    floor: float = -0.1


BLANKS = " \t\n\x0b\x0c\r"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds the words between blanks and their hashes."""
    parts = F.split(F.translate("text", BLANKS[1:], " " * 5), " ", -1)
    rows = docs.withColumn("words", F.filter(parts, lambda w: w != ""))
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def slots_of(slots: int) -> Column:
    """The slots of all words and of all pairs of neighbours."""
    single = F.transform("hashes", lambda h: F.pmod(h, F.lit(slots)).cast("int"))
    pairs = F.transform(
        F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(h, F.get("hashes", i + 1)), F.lit(slots)).cast("int"),
    )
    return F.concat(single, pairs)


def slot_weights(docs: DataFrame, labels: DataFrame, rules: Rules) -> list[float]:
    """log P(slot | trusted) - log P(slot | raw); zeros without a trusted document.

    Trusted counts are smoothed towards the raw corpus and rare slots have no weight. Both go by shares of the n-grams
    seen, so that a corpus and the same corpus many times over judge alike; a corpus too small for the least numbers keeps
    what it cannot judge.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.trusted_documents)
    marked = texts_of(docs).join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    grams = with_words(marked).select("trusted", F.explode(slots_of(rules.slots)).alias("slot"))
    counts = grams.groupBy("slot").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = [0] * rules.slots, [0] * rules.slots
    for r in counts:
        raw[r["slot"]], target[r["slot"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * rules.slots
    everything, trusted_grams = sum(raw), sum(target)
    pull = max(rules.prior_share * trusted_grams, rules.prior * rules.slots)
    least = max(rules.min_share * everything / rules.slots, rules.min_count)
    return [
        math.log((t * everything / r + pull) / (trusted_grams + pull)) if r and r >= least else 0.0 for t, r in zip(target, raw, strict=True)
    ]


def scored(docs: DataFrame, weights: list[float], rules: Rules) -> DataFrame:
    """One row per input row with its counts, score and verdict."""
    symbols = "#*$%&|<>"
    n = F.size("words")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    last = rules.window - 1
    windows = F.transform(
        F.slice("hashes", 1, F.greatest(n - last, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, rules.window)]),
    )
    rows = with_words(docs).select(
        "*", n.cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", symbols, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), windows.alias("windows"), slots_of(rules.slots).alias("slots"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("by_hash", F.when(twice, by_hash))
    repeated = F.filter("by_hash", lambda x, i: (F.get("by_hash", i - 1)["h"] == x["h"]) | (F.get("by_hash", i + 1)["h"] == x["h"]))
    rows = rows.withColumn("starts", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    reach = F.transform("starts", lambda s, i: F.least(F.lit(rules.window), F.coalesce(F.get("starts", i + 1) - s, F.lit(rules.window))))
    covered = F.aggregate(reach, F.lit(0), lambda a, x: a + x)
    ratios = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    total = F.aggregate("slots", F.lit(0.0), lambda a, s: a + F.get(ratios, s))
    rows = rows.select(
        "*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.size("slots") > 0, F.round(total / F.size("slots"), 9)).alias("score"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= rules.floor, F.lit(False)))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def quality(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, score and verdict of each row of (doc_id, text).

    A null or empty text has no words, a null score and fails. A null id is kept as it is and never counts as
    trusted. Repeated rows give repeated rows. Without a good label every score is 0, so only the plain rules
    decide. Windows of words are compared by a chained 64-bit hash. Other columns are not read.
    """
    return scored(texts_of(docs), slot_weights(docs, labels, rules), rules).select(*COLUMNS)


def filtered(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of documents, all their columns, that the rules keep."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("_document"))
    rows = scored(whole, slot_weights(docs, labels, rules), rules)
    # A filter on a row number stays above the projections; a filter on the verdict alone would be pushed below them
    # as one expression, in which the arrays of words are made anew for every word.
    return rows.withColumn("_row", F.monotonically_increasing_id()).filter("kept AND _row >= 0").select("_document.*")
