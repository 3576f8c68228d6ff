"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is rotated at random and keeps the signs of its coordinates, packed into bits, and one correction scalar.
The inner product with a query is estimated from the bits alone, with an error that shrinks with the number of bits.
A first pass over the codes finds a cosine that each query surely reaches k times; a second pass reranks, by exact
cosines, the vectors whose estimate plus error bound reaches it. Queries meet codes in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import map_batches, once
from newsflow.session import cut


@dataclass(frozen=True)
class OneBit:
    k: int = 5
    #: Bits of a code; a vector with more dimensions gets as many bits as dimensions, rounded up to whole bytes.
    bits: int = 512
    #: Standard deviations of the estimate's error that the bound covers: chance of a miss 3e-5 for each neighbour.
    deviations: float = 4.0
    #: Best estimates that the first pass reranks for each query in each block.
    first: int = 10
    #: Bytes of vectors in one block of each side, and most rows of a query block.
    block_bytes: int = 1 << 20
    query_rows: int = 1024
    #: Estimates that a task holds at a time, and pairs that it reranks at a time.
    cells: int = 1 << 22
    seed: int = 7


def rotation(dim: int, options: OneBit) -> np.ndarray:
    """Columns of a random rotation: maps `dim` coordinates, padded with zeros, to the bits' coordinates."""
    bits = -(-max(dim, options.bits) // 8) * 8

    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng([options.seed, bits, dim]).standard_normal((bits, dim)))
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)

    return once(f"rotation:{dim}:{bits}:{options.seed}", make)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which no cosine notices, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def summed(products: np.ndarray) -> np.ndarray:
    """Sum of each row from left to right, the same wherever the row stands."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(summed(vectors * vectors))


def encode(vectors: np.ndarray, options: OneBit) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each with its own signs as a unit vector."""
    turned = (vectors / norms(vectors)[:, None]) @ rotation(vectors.shape[1], options).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(codes: np.ndarray, correction: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Estimated cosines, code by query, from the bits and the rotated queries."""
    signs = np.unpackbits(codes, axis=1).astype(np.float32)
    ahead = signs @ (2 * turned.T) - turned.sum(axis=1)[None, :]
    return ahead / (np.sqrt(np.float32(turned.shape[1])) * correction[:, None].astype(np.float32))


def spread(correction: np.ndarray, bits: int, options: OneBit) -> np.ndarray:
    """Error bound of each code's estimate for vectors at a right angle; at cosine s it shrinks by sqrt(1 - s^2)."""
    # One part in a hundred thousand more for the estimate's own single precision.
    return options.deviations * np.sqrt(np.maximum(0.0, 1 - correction**2)) / (correction * np.sqrt(max(1, bits - 1))) + 1e-5


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, one for each id."""
    # For a component x, x - x is 0 if it is finite and NaN or null if not.
    finite = F.forall("embedding", lambda x: F.coalesce(x - x == 0, F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite & some)
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the lists the rows that have it and their values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(dims)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


BLOCK = "dim int, n int, vectors binary, ids binary, ends binary, codes binary, correction binary"


def point_blocks(points: DataFrame, options: OneBit) -> DataFrame:
    """Rows (ids, embedding) packed with their codes, one row per block."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            dims = np.asarray(batch.column(1).value_lengths())
            ids, counts = batch.column(0).flatten().to_numpy(), np.asarray(batch.column(0).value_lengths())
            starts = np.cumsum(counts) - counts
            for dim, at, vectors in _matrix(batch.column(1), dims):
                step = max(1, options.block_bytes // (8 * dim))
                for i in range(0, len(at), step):
                    part, held = scaled(vectors[i : i + step]), at[i : i + step]
                    codes, correction = encode(part, options)
                    yield {
                        "dim": [dim], "n": [len(held)], "vectors": [part.tobytes()],
                        "ids": [np.concatenate([ids[starts[j] : starts[j] + counts[j]] for j in held]).astype(np.int64).tobytes()],
                        "ends": [np.cumsum(counts[held]).astype(np.int64).tobytes()],
                        "codes": [codes.tobytes()], "correction": [correction.tobytes()],
                    }

    return map_batches(points.select("ids", "embedding"), BLOCK, body)


def query_blocks(queries: DataFrame, options: OneBit) -> DataFrame:
    """Rows (query, embedding, floor) packed, one row per block."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            query, floor = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for dim, at, vectors in _matrix(batch.column(1), np.asarray(batch.column(1).value_lengths())):
                step = max(1, min(options.query_rows, options.block_bytes // (8 * dim)))
                for i in range(0, len(at), step):
                    held = at[i : i + step]
                    yield {
                        "q_dim": [dim], "queries": [query[held].astype(np.int64).tobytes()],
                        "q_vectors": [scaled(vectors[i : i + step]).tobytes()], "floors": [floor[held].astype(np.float64).tobytes()],
                    }

    return map_batches(queries.select("query", "embedding", "floor"), "q_dim int, queries binary, q_vectors binary, floors binary", body)


def by_estimate(guess: np.ndarray, floors: np.ndarray, bound: np.ndarray, options: OneBit) -> np.ndarray:
    """The codes with the best estimates for each query."""
    n = min(options.first, len(guess))
    chosen = np.zeros(guess.shape, np.bool_)
    np.put_along_axis(chosen, np.argpartition(-guess, n - 1, axis=0)[:n], True, axis=0)
    return chosen


def by_bound(guess: np.ndarray, floors: np.ndarray, bound: np.ndarray, options: OneBit) -> np.ndarray:
    """The codes whose vector may reach the query's floor.

    A cosine s of at least the floor has an estimate of at least s - bound * sqrt(1 - s^2), which is smallest at the
    floor if that is not negative.
    """
    room = np.sqrt(np.clip(1 - np.maximum(floors, 0.0) ** 2, 0.0, 1.0))
    least = np.where(np.isfinite(floors), floors, -np.inf)
    return guess >= least[None, :] - bound[:, None] * room[None, :] - 1e-6


Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, OneBit], np.ndarray]


def meet(points: DataFrame, queries: DataFrame, rule: Rule, options: OneBit) -> DataFrame:
    """(query, vec_id, score): for each query and block of points the best k + 1 vectors that the rule lets through."""
    keep = options.k + 1

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] == row["q_dim"]:
                    yield _cell(row, rule, options, keep)

    pairs = points.crossJoin(queries)
    return map_batches(pairs, "query long, vec_id long, score double", body)


def _cell(row: dict, rule: Rule, options: OneBit, keep: int) -> dict:
    dim = row["dim"]
    held = {name: np.frombuffer(row[name], np.int64) for name in ("ids", "ends", "queries")}
    vectors, asked = np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["q_vectors"]).reshape(-1, dim)
    codes, correction = np.frombuffer(row["codes"], np.uint8).reshape(len(vectors), -1), np.frombuffer(row["correction"])
    floors = np.frombuffer(row["floors"])
    lengths, q_lengths = norms(vectors), norms(asked)
    turned = ((asked / q_lengths[:, None]) @ rotation(dim, options).T).astype(np.float32)
    bound = spread(correction, codes.shape[1] * 8, options)
    counts = np.diff(held["ends"], prepend=0)
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, options.cells // max(len(vectors), 1))
    for at in range(0, len(asked), step):
        mine = slice(at, at + step)
        # Every query is bound on its own floor; the best estimates are taken over the whole block.
        chosen = rule(estimates(codes, correction, turned[mine]), floors[mine], bound, options)
        q, p = np.nonzero(chosen.T)
        q += at
        pairs = max(1, options.cells // dim)
        score = np.concatenate([
            summed(vectors[p[i : i + pairs]] * asked[q[i : i + pairs]]) / (lengths[p[i : i + pairs]] * q_lengths[q[i : i + pairs]])
            for i in range(0, len(p), pairs)
        ] or [np.empty(0)])
        # Copies of a vector are one point with its smallest ids.
        many = counts[p]
        q, score, point = np.repeat(q, many), np.repeat(score, many), np.repeat(p, many)
        within = np.arange(len(point)) - np.repeat(np.cumsum(many) - many, many)
        ids = held["ids"][held["ends"][point] - counts[point] + within]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < keep
        out.append((held["queries"][q[best]], ids[best], score[best]))
    names = ("query", "vec_id", "score")
    return {n: np.concatenate([o[i] for o in out]) if out else np.empty(0) for i, n in enumerate(names)}


def _first(found: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def nearest(rows: DataFrame, every: int = 50, options: OneBit = OneBit()) -> DataFrame:
    """The k nearest rows, by cosine, of each row whose vec_id is divisible by `every`, all other rows being candidates.

    Returns query_id, rank from 1, vec_id, score; equal scores go to the smaller vec_id, and a query with fewer
    candidates gets all. Vectors that are null, empty, all zero or hold null or non-finite components take no part,
    nor do rows without an id. Repeated rows count once, and of an id with several vectors the least one counts.
    Vectors only meet vectors of their own length. Equal vectors are searched once, for all ids that have them. An
    empty table gives no rows; other columns are not read.
    """
    vectors = cut(usable(rows))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    points = (
        vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= options.k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    blocks = cut(point_blocks(points, options))
    asking = vectors.filter(F.col("vec_id") % every == 0)
    texts = asking.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    # Equal vectors share the smallest id among them as the name of their query.
    named = cut(asking.join(texts.withColumnRenamed("embedding", "same"), F.col("embedding") == F.col("same")).select(F.col("vec_id").alias("query_id"), "query", "embedding"))
    distinct = named.filter("query_id = query").select("query", "embedding")
    parts = max(1, -(-distinct.count() // options.query_rows))
    first = cut(meet(blocks, query_blocks(distinct.withColumn("floor", F.lit(float("-inf"))).repartition(parts), options), by_estimate, options))
    floors = first.transform(lambda f: _first(f, "query", options.k + 1)).filter(F.col("rank") == options.k + 1)
    bounded = distinct.join(floors.select("query", F.col("score").alias("floor")), "query", "left").select(
        "query", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")
    )
    second = meet(blocks, query_blocks(bounded.repartition(parts), options), by_bound, options)
    best = _first(first.unionByName(second).distinct(), "query", options.k + 1).drop("rank")
    answers = named.select("query_id", "query").join(best, "query").filter(F.col("query_id") != F.col("vec_id"))
    return _first(answers, "query_id", options.k).select("query_id", "rank", "vec_id", "score")
