"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

All word n-grams of test items are seeds. One pass over the documents cuts out the passages around seeds; each
distinct passage is aligned once with each item it shares a seed with, so edited copies score by what is left of the
item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import ALNUM, U64, bitmap, gram_hashes, in_bitmap, map_batches, mix, texts_of, word_hashes, word_spans
from newsflow.session import cut


@dataclass(frozen=True)
class Alignment:
    #: Words of a seed. Items with fewer words have one seed of all their words.
    seed_words: int = 5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: A passage counts from this part of an item's full score, or from as many matches as `long_match`.
    floor: float = 0.4
    long_match: int = 40


def _unspaced(view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each character of scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, kana, Han."""
    lead = np.flatnonzero(view >= 0xE0)
    a, b = view[lead], view[lead + 1]
    thai, khmer = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB), (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))
    kana = (a == 0xE3) & (b >= 0x81) & (b <= 0x83)
    han = ((a == 0xE3) & (b >= 0x90)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
    rare = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    chosen = thai | khmer | kana | han | rare
    return lead[chosen], lead[chosen] + np.where(rare[chosen], 4, 3)


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8, and start, end and hash of each run of letters, digits and other non-ASCII characters.

    A character of a script without blanks is a word of its own.
    """
    raw = text.lower().encode("utf-8", "surrogatepass")
    view = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(view, ALNUM)
    first, end = _unspaced(view)
    if len(first):
        # Runs are cut before and after each such character; nothing is lost in between.
        edges = np.unique(np.concatenate([starts, ends, first, end]))
        inside = np.searchsorted(starts, edges[:-1], "right") > np.searchsorted(ends, edges[:-1], "right")
        starts, ends = edges[:-1][inside], edges[1:][inside]
    return raw, starts, ends, word_hashes(view, starts, ends)


def seeds_of(items: DataFrame, options: Alignment) -> DataFrame:
    """(gram, item_id, n_words, size) of all n-grams of each item, however many items share one; size is its n."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"gram": [], "item_id": [], "n_words": [], "size": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)[3]
                for g in np.unique(gram_hashes(words, options.seed_words)).view(np.int64).tolist():
                    out["gram"].append(g)
                    out["item_id"].append(item)
                    out["n_words"].append(len(words))
                    out["size"].append(min(len(words), options.seed_words))
            yield out

    return cut(map_batches(items, "gram long, item_id long, n_words int, size int", body).distinct())


def passages_of(docs: DataFrame, held: np.ndarray, longest: int, sizes: list[int], options: Alignment) -> DataFrame:
    """Passages around words that may start a seed: an item's longest length and a quarter more on either side."""
    reach = longest + longest // 4 + options.seed_words
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = shared.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "text_id", "first_word", "passage", "passage_id", "grams")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, starts, ends, words = words_of(text)
                at, found = [], []
                for n in sizes:
                    if len(words) < n:
                        continue
                    grams = gram_hashes(words, n)
                    here = np.flatnonzero(in_bitmap(bits, grams))
                    here = here[in_bitmap(bits, mix(grams[here] + U64(1)))]
                    at.append(here)
                    found.append(grams[here])
                if not sum(map(len, at)):
                    continue
                at, found = np.concatenate(at), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                text_id = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                for part, grams in zip(np.split(at, cuts), np.split(found, cuts), strict=True):
                    first, last = max(0, int(part[0]) - reach), min(len(words), int(part[-1]) + options.seed_words + reach)
                    passage = raw[starts[first] : ends[last - 1]]
                    out["doc_id"].append(doc_id)
                    out["text_id"].append(text_id)
                    out["first_word"].append(first)
                    out["passage"].append(passage.decode("utf-8", "surrogatepass"))
                    out["passage_id"].append(hashlib.blake2b(passage, digest_size=16).digest())
                    out["grams"].append(np.unique(grams).view(np.int64).tolist())
            yield out

    schema = "doc_id long, text_id string, first_word int, passage string, passage_id binary, grams array<long>"
    return cut(map_batches(texts_of(docs), schema, body))


def smith_waterman(item: np.ndarray, passage: np.ndarray, options: Alignment) -> tuple[int, int, int]:
    """Score of the best local alignment of two sequences, and its first and end word in the passage.

    One vector operation per word of the item: a running maximum replaces the gaps along the passage. The start
    travels in the low half of each score; of equal scores the earliest start counts.
    """
    unit, width = np.int64(1) << 32, len(passage)
    column = np.arange(width + 1, dtype=np.int64)
    zero = (unit - 1) - column
    slope = column * (-options.gap * unit)
    above, best, end = zero.copy(), int(zero[0]), 0
    here = np.empty(width + 1, np.int64)
    for word in item:
        here[0] = zero[0]
        np.add(above[:-1], np.where(passage == word, options.match * unit, options.mismatch * unit), out=here[1:])
        np.maximum(here[1:], above[1:] + options.gap * unit, out=here[1:])
        np.maximum(here, zero, out=here)
        row = np.maximum.accumulate(here + slope) - slope
        k = int(row.argmax())
        if int(row[k]) > best:
            best, end = int(row[k]), k
        above = row
    return best >> 32, int(unit - 1) - (best & int(unit - 1)), end


def contaminated(docs: DataFrame, items: DataFrame, options: Alignment = Alignment()) -> DataFrame:
    """One row per document and test item that a passage of it aligns with.

    (doc_id, text_id, item_id, score, first_word, end_word): score is the best alignment's score as a part of the
    item's full one, the words are its place in the document, text_id the MD5 of the document's text. Null and empty
    texts and items have no words and no rows; repeated rows of either table count once; null ids are kept as they
    are. Without items or documents there are no rows. Other columns are not read.
    """
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    seeds = seeds_of(items, options)
    known = seeds.agg(F.max("n_words").alias("longest"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    longest, sizes = known["longest"] or 0, list(known["sizes"])
    # Two probes per seed in a bitmap of fixed size; what passes it by chance falls out of the join below.
    doubled = map_batches(
        seeds.select("gram"), "gram long",
        lambda batches: ({"gram": np.concatenate([g := b.column(0).to_numpy(), mix(g.view(U64) + U64(1)).view(np.int64)])} for b in batches),
    )
    passages = passages_of(docs, bitmap(doubled, F.col("gram")), longest, sizes, options)
    keyed = passages.select("passage_id", F.explode("grams").alias("gram")).distinct()
    pairs = keyed.join(seeds, "gram").select("passage_id", "item_id").distinct()
    unique = passages.groupBy("passage_id").agg(F.first("passage").alias("passage"))
    wanted = items.filter("text <> ''").distinct().withColumnRenamed("text", "item")
    joined = pairs.join(unique, "passage_id").join(wanted, pairs["item_id"].eqNullSafe(wanted["item_id"]))
    both = joined.select("passage_id", pairs["item_id"], "passage", "item")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("passage_id", "item_id", "points", "score", "first", "end")}
            for passage_id, item_id, passage, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = words_of(item)[3], words_of(passage)[3]
                full = options.match * len(own)
                least = min(options.floor * full, options.match * options.long_match)
                # No alignment has more matches than the item has words that the passage has too.
                if not full or options.match * np.isin(own, other).sum() < least:
                    continue
                points, first, end = smith_waterman(own, other, options)
                if points >= least:
                    for k, v in zip(out, (passage_id, item_id, points, points / full, first, end), strict=True):
                        out[k].append(v)
            yield out

    hits = map_batches(both, "passage_id binary, item_id long, points int, score double, first int, end int", align)
    rows = passages.select("doc_id", "text_id", "first_word", "passage_id").join(hits, "passage_id")
    best = F.max(F.struct("score", (-(F.col("first") + F.col("first_word"))).alias("from"), (F.col("end") + F.col("first_word")).alias("to")))
    out = rows.groupBy("doc_id", "text_id", "item_id").agg(best.alias("best"))
    return out.select(
        "doc_id", "text_id", "item_id", F.round("best.score", 9).alias("score"), (-F.col("best.from")).cast("long").alias("first_word"),
        F.col("best.to").cast("long").alias("end_word"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, options: Alignment = Alignment()) -> DataFrame:
    """The rows of documents, all their columns, without those that hold a passage of a test item."""
    bad = contaminated(docs, items, options).select(F.col("doc_id").alias("_bad_id"), F.col("text_id").alias("_bad_text")).distinct()
    # Whole rows travel as one column, so that no name of theirs can clash.
    marked = docs.select(F.struct("*").alias("document"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    left = marked.join(bad, F.expr("document.doc_id <=> _bad_id AND text_md5 = _bad_text"), "left_anti")
    return left.select("document.*")
