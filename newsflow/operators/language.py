"""Language classification from letter trigrams. Spark folds texts; tasks count and score their grams in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from newsflow.session import cut

#: Characters that a task works on at a time.
AT_ONCE = 1 << 20
#: Numbers of a profile that a task holds; its further grams are joined.
HELD = 1 << 22
#: Bits of a character in the number of a gram.
BITS = 21


def folded(text: Column) -> Column:
    """The lower-cased text between blanks, other characters than letters read as one blank."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """All letter trigrams of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit("(?=(...))"), F.lit(1))


def _blocks(texts: Iterable[tuple[object, str]]) -> Iterator[tuple[list, list[str]]]:
    """Tags and texts of about AT_ONCE characters; a longer text comes in pieces that have two characters in common."""
    tags, pieces, held = [], [], 0
    for tag, text in texts:
        for at in range(0, len(text) - 2, AT_ONCE):
            tags.append(tag)
            pieces.append(text[at : at + AT_ONCE + 2])
            held += len(pieces[-1])
            if held >= AT_ONCE:
                yield tags, pieces
                tags, pieces, held = [], [], 0
    if pieces:
        yield tags, pieces


def _numbers(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of each piece as numbers, and the place of the piece."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    whole = owner[2:] == owner[:-2]
    return (codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:])[whole], owner[:-2][whole]


def _letters(numbers: np.ndarray) -> list[str]:
    codes = np.stack([numbers >> 2 * BITS, numbers >> BITS & (1 << BITS) - 1, numbers & (1 << BITS) - 1], axis=1)
    return np.ascontiguousarray(codes, "<u4").view("<U3").ravel().tolist()


def profile_counts(texts: DataFrame) -> DataFrame:
    """`lang, gram, n` of labelled texts. Counts of several sets of texts add up, so each cycle may bring its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": _letters(grams), "n": n})
            held.clear()

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for tags, pieces in _blocks(row for row in rows if row[1] is not None):
                grams, owner = _numbers(pieces)
                names = sorted(set(tags))
                lang = np.array([names.index(tag) for tag in tags])[owner]
                for i, name in enumerate(names):
                    before, n = held.get(name, (grams[:0], grams[:0]))
                    mine, times = np.unique(grams[lang == i], return_counts=True)
                    known, place = np.unique(np.concatenate([before, mine]), return_inverse=True)
                    sums = np.zeros(len(known), np.int64)
                    np.add.at(sums, place, np.concatenate([n, times]))
                    held[name] = known, sums
                if sum(len(known) for known, _ in held.values()) > AT_ONCE:
                    yield from out()
        yield from out()

    rows = texts.filter("lang IS NOT NULL").select("lang", folded(F.col("text")).alias("text"))
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def merged_counts(parts: list[DataFrame]) -> DataFrame:
    """One table of counts from those of several cycles; rows are bounded by the alphabet, not by the cycles."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train_profiles(texts: DataFrame) -> DataFrame:
    return profiles_of(profile_counts(texts))


def profiles_of(counts: DataFrame) -> DataFrame:
    """`lang, gram, log_p` with add-one smoothing; rows are bounded by the alphabet, not by the texts."""
    counts = cut(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = counts.select("gram").distinct()
    # One row per gram and language; the languages are few and come as one array value.
    languages = totals.agg(F.collect_list(F.struct("lang", "total")).alias("l"))
    every = (
        vocabulary.select("gram", F.explode(languages.scalar()).alias("l")).select("gram", "l.lang", "l.total")
        .join(counts, ["lang", "gram"], "left")
    )
    size = vocabulary.agg(F.count("*").alias("v"))
    return every.withColumn("v", size.scalar()).select(
        "lang", "gram", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("v"))).alias("log_p")
    )


def detect_language(texts: DataFrame, profiles: DataFrame, id_col: str) -> DataFrame:
    """Language with the highest log likelihood per text; texts without a known trigram give no row.

    The profile is turned to one row per gram with a number per language. Tasks hold the likeliest grams, of a size fixed
    beforehand, and add up the numbers of a text; only grams of a larger profile that are not held are joined.
    """
    profiles = cut(profiles)
    languages = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    wide = cut(profiles.groupBy("gram").pivot("lang", languages).agg(F.first("log_p")).select(
        "gram", F.array(*[F.col(f"`{code}`") for code in languages]).alias("p")
    ))
    likeliest, most = F.array_max("p"), HELD // len(languages)
    size = wide.count()
    least = wide.agg(F.percentile_approx(likeliest, 1 - most / size).alias("p")).first().p if size > most else None
    scores = _scored(texts, wide if least is None else wide.filter(likeliest > least), id_col, len(languages))
    if least is not None:
        grams = texts.select(id_col, F.explode(trigrams(F.col("text"))).alias("gram"))
        scores = scores.unionByName(grams.join(wide.filter(likeliest <= least), "gram").select(id_col, F.col("p").alias("s")))
    scores = scores.groupBy(id_col).agg(*[F.sum(F.get("s", F.lit(n))).alias(f"s{n}") for n in range(len(languages))])
    best = F.greatest(*[F.col(f"s{n}") for n in range(len(languages))]) if len(languages) > 1 else F.col("s0")
    found = F.coalesce(*[F.when(F.col(f"s{n}") == best, F.lit(code)) for n, code in enumerate(languages)])
    return scores.select(id_col, found.alias("detected"))


def _scored(texts: DataFrame, wide: DataFrame, id_col: str, width: int) -> DataFrame:
    """`id, s`: sums of the given grams' numbers for each text that has one of them."""
    held = wide.toArrow()
    grams = _numbers(held.column("gram").to_pylist())[0]
    order = np.argsort(grams)
    numbers = np.array(held.column("p").to_pylist(), float).reshape(-1, width)
    shared = texts.sparkSession.sparkContext.broadcast((grams[order], numbers[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shared.value
        for batch in batches:
            sums, seen = np.zeros((width, len(batch))), np.zeros(len(batch), bool)
            rows = enumerate(batch.column(1).to_pylist())
            for tags, pieces in _blocks(row for row in rows if row[1] is not None):
                grams, owner = _numbers(pieces)
                place = np.searchsorted(known, grams)
                place[place == len(known)] = 0
                hit = known[place] == grams if len(known) else np.zeros(len(grams), bool)
                place, text = place[hit], np.array(tags)[owner[hit]]
                seen[text] = True
                for k in range(width):
                    sums[k] += np.bincount(text, numbers[place, k], len(batch))
            # One list of numbers for each row that has any.
            lists = pa.array(list(sums.T[seen]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(seen)), lists], names=[id_col, "s"])

    rows = texts.select(id_col, folded(F.col("text")).alias("text"))
    return rows.mapInArrow(score, StructType([rows.schema[id_col]]).add("s", ArrayType(DoubleType())))
