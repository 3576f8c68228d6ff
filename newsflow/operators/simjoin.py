"""Exact cosine joins over arrays of floats.

Vectors are hashed into blocks of bounded size and every pair of blocks that must meet becomes one
shuffle key, so a task holds two blocks however large a group is. A task multiplies the two blocks and
hands on a reduced answer (best match, nearest points, spanning edges) rather than every pair, which
keeps what leaves a task proportional to the rows that entered it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID, VEC, LO, HI, AT = "id", "vec", "lo", "hi", "at"
_DIGITS = 12


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix of unit rows; a zero vector stays zero."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = pa.chunked_array([c.flatten() for c in column.chunks]).to_numpy()
    rows = flat.astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows, rounded so that the order of summation cannot change a comparison."""
    return np.round(a @ b.T, _DIGITS)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# --- what a pair of blocks hands on -------------------------------------------------------------

def _all(sim, mask, q, p):
    i, j = np.nonzero(mask)
    return i, j


def _best(sim, mask, q, p):
    """Per query row every point that reaches the maximum (normally one)."""
    top = np.where(mask, sim, -np.inf).max(axis=1, keepdims=True) if sim.shape[1] else None
    if top is None:
        return np.empty(0, int), np.empty(0, int)
    return np.nonzero(mask & (sim == top))


def _nearest(k: int):
    def reduce(sim, mask, q, p):
        """Per query row the k nearest points, ties by point id."""
        i, j = np.nonzero(mask)
        order = np.lexsort((p[j], -sim[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        return i[keep], j[keep]

    return reduce


def _any(sim, mask, q, p):
    """Per query row one point, the lowest id, as proof that some point matches."""
    hit = mask.any(axis=1)
    order = np.argsort(p, kind="stable")
    j = order[mask[:, order].argmax(axis=1)] if mask.shape[1] else np.zeros(len(hit), int)
    i = np.nonzero(hit)[0]
    return i, j[i]


def _counted(sim, mask, q, p):
    """Per query row with a match one point, and how many match in place of the cosine."""
    many = mask.sum(axis=1)
    i = np.nonzero(many)[0]
    sim[i, 0] = many[i]
    return i, np.zeros(len(i), int)


def _spanning(sim, mask, q, p):
    """Enough edges to keep the connected components of the block pair, at most one per row added."""
    ids = {}
    for value in np.concatenate([q, p]):
        ids.setdefault(value, len(ids))
    left = np.array([ids[v] for v in q], dtype=int)
    right = np.array([ids[v] for v in p], dtype=int)
    root = np.arange(len(ids))
    out_i, out_j = [], []
    for row in range(mask.shape[0]):
        cols = np.nonzero(mask[row])[0]
        if not len(cols):
            continue
        labels = root[right[cols]]
        _, first = np.unique(labels, return_index=True)
        cols, labels = cols[first], labels[first]
        keep = labels != root[left[row]]
        if not keep.any():
            continue
        out_i.extend([row] * int(keep.sum()))
        out_j.extend(cols[keep])
        merged = np.append(labels[keep], root[left[row]])
        root[np.isin(root, merged)] = merged.min()
    return np.array(out_i, dtype=int), np.array(out_j, dtype=int)


# --- one pair of blocks -------------------------------------------------------------------------

def _meet(reduce, floor: float, ordered: bool, timed: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or points.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "point_id": pa.array([], pa.int64()),
                             "cosine": pa.array([], pa.float64())})
        sim = cosines(unit_rows(queries.column(VEC)), unit_rows(points.column(VEC)))
        q, p = _numpy(queries, ID), _numpy(points, ID)
        mask = sim >= floor
        if ordered:
            mask &= p[None, :] < q[:, None]
        if timed:
            at = _numpy(points, AT)[None, :]
            mask &= (at >= _numpy(queries, LO)[:, None]) & (at < _numpy(queries, HI)[:, None])
        i, j = reduce(sim, mask, q, p)
        return pa.table({"query_id": pa.array(q[i], pa.int64()), "point_id": pa.array(p[j], pa.int64()),
                         "cosine": pa.array(sim[i, j], pa.float64())})

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys]
                     + ["query_id bigint", "point_id bigint", "cosine double"])


def _keyed(keys: list[str], key, out: pa.Table) -> pa.Table:
    """Put the group key back in front of a task's answer."""
    for n, name in enumerate(keys):
        out = out.add_column(n, name, pa.repeat(key[n], out.num_rows))
    return out


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64(ID), count).cast("int")


def _block_counts(counts: DataFrame, names: list[str], block_rows: int, keys: list[str]) -> DataFrame:
    """Groups that need more than one block: few rows, at most the input divided by the block size."""
    over = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    return counts.filter(over > block_rows).select(
        *keys, *[F.ceil(F.col(n) / block_rows).alias(f"{n}_blocks") for n in names]
    )


def _add_blocks(df: DataFrame, counts: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return df.join(counts, keys, "left").fillna(1, [f"{n}_blocks" for n in names])


def _one_row_counts(sizes: dict[str, int], df: DataFrame, block_rows: int) -> DataFrame:
    return df.select("*", *[
        F.lit(max(1, -(-n // block_rows))).cast("bigint").alias(f"{name}_blocks") for name, n in sizes.items()
    ])


def within(
    rows: DataFrame, reduce, floor: float, keys: list[str], block_rows: int, ordered: bool = True
) -> DataFrame:
    """Join a table of (keys, id, vec) with itself inside each key: triangular grid of blocks."""
    rows = rows.select(*keys, ID, VEC)
    if keys:
        counts = _block_counts(rows.groupBy(*keys).agg(F.count("*").alias("n")), ["n"], block_rows, keys)
        blocks = _add_blocks(rows, counts, ["n"], keys)
    else:
        blocks = _one_row_counts({"n": rows.count()}, rows, block_rows)
    mine = blocks.withColumn("b", _block(F.col("n_blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")))
    )
    grid = mine.select(
        *keys, F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "b", ID, VEC
    )
    meet = _meet(reduce, floor, ordered, timed=False)

    def body(table: pa.Table) -> pa.Table:
        b = _numpy(table, "b")
        first, last = b.min(), b.max()
        same = (_numpy(table, "b1") == _numpy(table, "b2"))[0]
        if same:
            return meet(table, table)
        if first == last:
            return meet(table.slice(0, 0), table)
        low, high = table.filter(pa.array(b == first)), table.filter(pa.array(b == last))
        return pa.concat_tables([meet(low, high), meet(high, low)])

    return grid.groupBy(*keys, "b1", "b2").applyInArrow(
        lambda key, table: _keyed(keys, key, body(table)), _schema(rows, keys)
    )


def between(
    queries: DataFrame, points: DataFrame, reduce, floor: float, keys: list[str], block_rows: int,
    ordered: bool = False, timed: bool = False,
) -> DataFrame:
    """Join (keys, id, vec[, lo, hi]) with (keys, id, vec[, at]): full grid of query and point blocks."""
    queries = queries.select(*keys, ID, VEC, *([LO, HI] if timed else []))
    points = points.select(*keys, ID, VEC, *([AT] if timed else []))
    if keys:
        sizes = queries.groupBy(*keys).agg(F.count("*").alias("q")).join(
            points.groupBy(*keys).agg(F.count("*").alias("p")), keys
        )
        counts = _block_counts(sizes, ["q", "p"], block_rows, keys)
        left = _add_blocks(queries, counts, ["q", "p"], keys)
        right = _add_blocks(points, counts, ["q", "p"], keys)
    else:
        sizes = {"q": queries.count(), "p": points.count()}
        left = _one_row_counts(sizes, queries, block_rows)
        right = _one_row_counts(sizes, points, block_rows)
    span = lambda name: F.explode(F.sequence(F.lit(0), (F.col(name) - 1).cast("int")))
    left = left.withColumn("qb", _block(F.col("q_blocks"))).withColumn("pb", span("p_blocks"))
    right = right.withColumn("pb", _block(F.col("p_blocks"))).withColumn("qb", span("q_blocks"))
    grid = [*keys, "qb", "pb"]
    left, right = _renewed(left.drop("q_blocks", "p_blocks")), _renewed(right.drop("q_blocks", "p_blocks"))
    meet = _meet(reduce, floor, ordered, timed)
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(
        lambda key, q, p: _keyed(keys, key, meet(q, p)), _schema(queries, keys)
    )


def _renewed(df: DataFrame) -> DataFrame:
    """Fresh column identities, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# --- operators ----------------------------------------------------------------------------------

def _vectors(df: DataFrame, id_col: str, keys: list[str], *more: Column) -> DataFrame:
    return df.select(*keys, F.col(id_col).cast("bigint").alias(ID), F.col("embedding").alias(VEC), *more)


def similar_pairs(
    df: DataFrame, floor: float, id_col: str = "seq", keys: list[str] = ("batch_id",), block_rows: int = 2048
) -> DataFrame:
    """Every pair (earlier, later) inside a key whose cosine reaches the floor."""
    keys = list(keys)
    found = within(_vectors(df, id_col, keys), _all, floor, keys, block_rows)
    return found.select(*keys, F.col("point_id").alias("earlier"), F.col("query_id").alias("later"), "cosine")


def spanning_pairs(
    df: DataFrame, floor: float, id_col: str = "seq", keys: list[str] = ("batch_id",), block_rows: int = 2048
) -> DataFrame:
    """A subset of `similar_pairs` with the same connected components, without quadratic output.

    Equal vectors are chained to their first copy before the join, so copies never meet each other.
    """
    keys = list(keys)
    rows = _vectors(df, id_col, keys)
    firsts = rows.groupBy(*keys, VEC).agg(F.min(ID).alias(ID))
    copies = rows.join(firsts.withColumnRenamed(ID, "first"), [*keys, VEC]).filter(
        (F.col(ID) != F.col("first")) & F.exists(VEC, lambda x: x != 0)
    )
    near = within(firsts, _spanning, floor, keys, block_rows)
    return near.select(*keys, F.col("point_id").alias("earlier"), F.col("query_id").alias("later")).unionByName(
        copies.select(*keys, F.col("first").alias("earlier"), F.col(ID).alias("later"))
    )


def best_earlier(rows: DataFrame, floor: float, keys: list[str], block_rows: int) -> DataFrame:
    """For each row its most similar earlier rows (all that tie)."""
    return _top(within(rows, _best, floor, keys, block_rows), keys)


def best_of(
    queries: DataFrame, points: DataFrame, floor: float, keys: list[str], block_rows: int, ordered: bool = False
) -> DataFrame:
    return _top(between(queries, points, _best, floor, keys, block_rows, ordered=ordered), keys)


def _top(found: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the answers of several blocks: keep the points that reach the overall maximum."""
    top = found.groupBy(*keys, "query_id").agg(F.max("cosine").alias("top"))
    return found.join(top, [*keys, "query_id"]).filter(F.col("cosine") == F.col("top")).drop("top")


def having_earlier(rows: DataFrame, floor: float, keys: list[str], block_rows: int) -> DataFrame:
    """Ids of rows with at least one similar earlier row."""
    return within(rows, _any, floor, keys, block_rows).select(*keys, F.col("query_id").alias(ID)).distinct()


def earlier_counts(rows: DataFrame, floor: float, keys: list[str], block_rows: int) -> DataFrame:
    """(keys, id, n) of rows with similar earlier rows, and how many they are."""
    found = within(rows, _counted, floor, keys, block_rows)
    return found.groupBy(*keys, F.col("query_id").alias(ID)).agg(F.sum("cosine").cast("bigint").alias("n"))


def having_match(
    queries: DataFrame, points: DataFrame, floor: float, keys: list[str], block_rows: int, ordered: bool
) -> DataFrame:
    found = between(queries, points, _any, floor, keys, block_rows, ordered=ordered)
    return found.select(*keys, F.col("query_id").alias(ID)).distinct()


def _nearest_in_window(queries, points, k, floor, query_id, point_id, at, as_of, hours, block_rows) -> DataFrame:
    """(query_id, point_id, cosine, rank) of the k nearest points with as_of - hours <= at.

    A constant `as_of` is a plain filter that reaches the scan. A column `as_of` (replays over many cycles) also bounds
    the window above, per query. Queries that may travel go to the points; a larger set meets them in a grid of blocks.
    """
    from newsflow.operators import scanjoin

    if timed := isinstance(as_of, str):
        width, hi = int(hours * 3600) * 1_000_000, F.unix_micros(F.col(as_of))
        q = _vectors(queries, query_id, [], (hi - width).alias(LO), hi.alias(HI))
        p = _vectors(points, point_id, [], F.unix_micros(at).alias(AT))
    else:
        now = as_of if isinstance(as_of, Column) else F.lit(as_of)
        q = _vectors(queries, query_id, [])
        p = _vectors(points.filter(F.col(at) >= now - F.expr(f"INTERVAL {int(hours * 3600)} SECOND")), point_id, [])
    if scanjoin.within_reach(q):
        return scanjoin.nearest(q, p, k, floor, timed)
    keys = []
    if timed:
        # Buckets as wide as the window: a point meets the one or two buckets of queries that can see it.
        keys = ["bucket"]
        q = q.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(LO) / width), F.floor((F.col(HI) - 1) / width))))
        p = p.withColumn("bucket", F.floor(F.col(AT) / width))
    found = between(q, p, _nearest(k), floor, keys, block_rows, timed=timed)
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("point_id"))
    return (
        found.select("query_id", "point_id", "cosine")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def best_recent(
    queries: DataFrame, points: DataFrame, floor: float, at: str, as_of, hours: float,
    query_id: str = "article_id", point_id: str = "point_id", block_rows: int = 2048,
) -> DataFrame:
    """Per query its most similar point in the look-back window, if it reaches the floor.

    Returns `query_id, point_id, cosine`, one row per matched query; ties go to the lowest point id.
    """
    return _nearest_in_window(queries, points, 1, floor, query_id, point_id, at, as_of, hours, block_rows).drop("rank")


def nearest_points(
    queries: DataFrame, points: DataFrame, k: int, floor: float, at: str, as_of, hours: float,
    query_id: str = "article_id", point_id: str = "point_id", block_rows: int = 2048,
) -> DataFrame:
    """The k nearest points of each query in the window, of which those that reach the floor.

    Points below the floor sort after all points above it, so applying the floor first cannot change
    which of the k nearest remain.
    """
    return _nearest_in_window(queries, points, k, floor, query_id, point_id, at, as_of, hours, block_rows)
