"""The trie of conversation prefixes, encoded per shard as balanced parentheses.

Every prefix of turns is named by a chained SHA-256, so equal prefixes meet wherever their conversations lie. The nodes
of the trie are dealt into layers by how much hangs below them, and within a layer into subtrees; a shard holds whole
subtrees as one string of parentheses. Blocks of least excess answer findclose, which delimits a subtree; the rank of
"()" counts its leaves, a cumulative array its savings. Nodes above the first layer are the spines that many shards
share: what hangs below them arrives as sums of finished subtrees, layer by layer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import map_batches
from newsflow.session import cut


@dataclass(frozen=True)
class Trie:
    #: A conversation takes its first turns from the one that its id, less the remainder by this, names.
    group: int = 100
    #: It takes crc32(id) modulo this.
    heads: int = 6
    #: Turns below a node that may lie in one subtree of the first layer, and about the nodes in one shard.
    shard_nodes: int = 50_000
    #: Each further layer holds nodes with up to this many times more below them.
    layer_factor: int = 64


# --- conversations ------------------------------------------------------------------------------

def rebuilt(conversations: DataFrame, options: Trie) -> DataFrame:
    """(conv_id, part, pos, role, text) by turn of the rebuilt conversations, and a row of part 0 that begins each."""
    told = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = cut(told.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(options.heads)).cast("int")
    starts = own.filter("pos = 1").select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % options.group).alias("base"))
    lent = own.filter((F.col("pos") < options.heads) & (F.col("conv_id") % options.group == 0)).select(
        F.col("conv_id").alias("base"), "pos", "role", "text"
    )
    none = F.lit(None).cast("string")
    begin = starts.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), none.alias("role"), none.alias("text"))
    first = starts.join(lent, "base").filter("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "role", "text")
    rest = own.filter(F.col("pos") > taken).select("conv_id", F.lit(2).alias("part"), "pos", "role", "text")
    return begin.unionByName(first).unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, final): the prefixes of every conversation, read in order row by row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # The row that waits is a conversation's last until the next row says otherwise.
        waiting: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            conv, part, role, text = (batch.column(n).to_pylist() for n in ("conv_id", "part", "role", "text"))
            for c, p, r, t in zip(conv, part, role, text, strict=True):
                if waiting is not None:
                    out.append((*waiting, p == 0))
                if p == 0:
                    waiting = (c, 0, _ROOT, None, 0)
                    continue
                _, depth, above, _, _ = waiting
                named = r.encode()
                node = hashlib.sha256(b"%b%d %b%b" % (above, len(named), named, t.encode())).digest()
                waiting = (c, depth + 1, node, above, len(t))
            if out:
                yield dict(zip(_PREFIX, map(list, zip(*out, strict=True)), strict=True))
        if waiting is not None:
            yield {n: [v] for n, v in zip(_PREFIX, (*waiting, True), strict=True)}

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return map_batches(ordered, "conv_id long, depth long, node binary, parent binary, chars long, final boolean", body)


_ROOT = hashlib.sha256(b"").digest()
_PREFIX = ("conv_id", "depth", "node", "parent", "chars", "final")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: their ids are hashed in order as they stream by."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            nodes, told = [], []
            for node, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(b",%d" % c)
                    continue
                if now is not None:
                    nodes.append(now)
                    told.append(digest.hexdigest())
                now, digest = node, hashlib.sha256(b"%d" % c)
            if nodes:
                yield {"node": nodes, "ends_sha256": told}
        if now is not None:
            yield {"node": [now], "ends_sha256": [digest.hexdigest()]}

    ordered = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return map_batches(ordered, "node binary, ends_sha256 string", body)


# --- balanced parentheses -----------------------------------------------------------------------

_BLOCK = 64


class Parentheses:
    """A forest as balanced parentheses, with least excess by block and a tree of these above."""

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens
        steps = np.where(opens, 1, -1).astype(np.int32)
        self.excess = np.cumsum(steps, dtype=np.int32)
        blocks = max(1, -(-len(opens) // _BLOCK))
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(opens)] = self.excess
        self.padded = padded.reshape(blocks, _BLOCK)
        width = 1 << (blocks - 1).bit_length()
        level = np.full(width, np.iinfo(np.int32).max, np.int32)
        level[:blocks] = self.padded.min(axis=1)
        #: Least excess of runs of 1, 2, 4 ... blocks.
        self.levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).min(axis=1)
            self.levels.append(level)
        self.before = np.concatenate([[0], np.cumsum(opens)])
        # A pair "()" begins at each place where a parenthesis opens and the next closes.
        pair = np.zeros(len(opens), np.int64)
        pair[:-1] = opens[:-1] & ~opens[1:]
        self.pairs = np.concatenate([[0], np.cumsum(pair)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before a place."""
        return self.before[at]

    def leaf_pairs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs "()" that lie in start .. end - 1."""
        return self.pairs[end] - self.pairs[start]

    def _within(self, block: np.ndarray, first: np.ndarray, most: np.ndarray) -> np.ndarray:
        """First place in the block, at `first` or later, whose excess is at most `most`; the block's end without one."""
        out = np.empty(len(block), np.int64)
        for at in range(0, len(block), 1 << 16):
            part = slice(at, at + (1 << 16))
            hit = (self.padded[block[part]] <= most[part, None]) & (np.arange(_BLOCK)[None, :] >= first[part, None])
            out[part] = np.where(hit.any(axis=1), hit.argmax(axis=1), _BLOCK)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place that closes the parenthesis opened at each place: the next with one less excess."""
        target = self.excess[at] - 1
        block, inside = at // _BLOCK, at % _BLOCK
        found = self._within(block, inside + 1, target)
        open_still = np.flatnonzero(found == _BLOCK)
        # Up the tree until a run to the right reaches the target, then down to its first block that does.
        node, want = block[open_still] + 1, target[open_still]
        result = np.zeros(len(open_still), np.int64)
        climbing = np.arange(len(open_still))
        level = 0
        rank = np.zeros(len(open_still), np.int64)
        while len(climbing):
            least = self.levels[level]
            n = node[climbing]
            there = (n < len(least)) & (least[np.minimum(n, len(least) - 1)] <= want[climbing])
            rank[climbing[there]] = level
            climbing = climbing[~there]
            # An even run is followed by its sibling in the same parent, an odd one is its parent's last.
            node[climbing] = (node[climbing] + 1) >> 1
            level += 1
            if level >= len(self.levels) and len(climbing):
                raise ValueError("parentheses are not balanced")
        for down in range(len(self.levels) - 1, 0, -1):
            going = np.flatnonzero(rank == down)
            left = 2 * node[going]
            node[going] = np.where(self.levels[down - 1][left] <= want[going], left, left + 1)
            rank[going] = down - 1
        result = node * _BLOCK + self._within(node, np.zeros(len(node), np.int64), want)
        out = block * _BLOCK + found
        out[open_still] = result
        return out


def encoded(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses of a forest given by the place of each row's parent (-1 at the top), and the rows in their order."""
    n = len(parent)
    by_parent = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by_parent], np.arange(-1, n + 1))
    children, first = by_parent.tolist(), first.tolist()
    opens, order = bytearray(2 * n), []
    at, stack = 0, children[first[0] : first[1]][::-1]
    while stack:
        row = stack.pop()
        if row >= 0:
            opens[at] = 1
            order.append(row)
            stack.append(-1)
            stack += children[first[row + 1] : first[row + 2]][::-1]
        at += 1
    return np.frombuffer(opens, np.uint8).astype(np.bool_), np.array(order, np.int64)


def subtree_sums(parent: np.ndarray, own: np.ndarray, hung_leaves: np.ndarray, leaves_here: bool) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings of every row's subtree in a forest."""
    opens, order = encoded(parent)
    tree = Parentheses(opens)
    start = np.flatnonzero(opens)
    end = tree.findclose(start) + 1
    total = lambda values: (c := np.concatenate([[0], np.cumsum(values[order])]))[tree.rank(end)] - c[tree.rank(start)]
    leaves, saved = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    leaves[order] = tree.leaf_pairs(start, end) if leaves_here else total(hung_leaves)
    saved[order] = total(own)
    return leaves, saved


# --- nodes, layers, shards ----------------------------------------------------------------------

def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, parent, depth, chars, conv_id, n_convs, below) from the prefixes of distinct conversations."""
    return rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        F.sum("copies").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
    )


def layer(below: Column, options: Trie) -> Column:
    """0 for nodes with at most a shard's turns below them, one more for each further factor."""
    over = F.log(float(options.layer_factor), F.greatest(below / options.shard_nodes, F.lit(1.0)))
    return F.ceil(over).cast("int")


FINISHED = "node binary, parent binary, top boolean, n_leaves long, saved long, hung int, saved_tokens long"


def shards(rows: DataFrame, parts: int, first: bool, options: Trie) -> DataFrame:
    """Leaves and savings by node, from the nodes of a layer and what hangs on them from below."""

    def finished(held: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda n: table.column(n).chunk(0)
        place = {node: i for i, node in enumerate(column("node").to_pylist())}
        top = np.asarray(column("top").to_numpy(zero_copy_only=False), np.bool_)
        parent = np.array([-1 if t else place[p] for p, t in zip(column("parent").to_pylist(), top.tolist(), strict=True)], np.int64)
        own, hung_leaves, hung_saved, hung = (column(n).to_numpy() for n in ("own", "hung_leaves", "hung_saved", "hung"))
        leaves, saved = subtree_sums(parent, own + hung_saved, hung_leaves, first)
        children = np.bincount(parent[parent >= 0], minlength=len(parent)) + hung
        return {"node": column("node"), "parent": column("parent"), "top": top, "n_leaves": leaves, "saved_tokens": saved, "n_children": children}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # Rows come subtree by subtree, so a shard may end wherever the next subtree begins.
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_pylist()
            if size >= options.shard_nodes:
                cut_at = next((i for i, t in enumerate(tree) if t != last), None)
                if cut_at is not None:
                    if cut_at:
                        held.append(batch.slice(0, cut_at))
                    yield finished(held)
                    batch, held, size = batch.slice(cut_at), [], 0
            held.append(batch)
            size += batch.num_rows
            last = tree[-1]
        if held:
            yield finished(held)

    ordered = rows.repartition(parts, "tree").sortWithinPartitions("tree")
    return map_batches(ordered, "node binary, parent binary, top boolean, n_leaves long, saved_tokens long, n_children long", body)


def trie(conversations: DataFrame, options: Trie = Trie()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns are in the order of turn (null first), then role, then text; a null role or text is an empty one; a repeated
    row is a turn of its own. Rows without a conv_id take no part. An empty table gives no rows, not even a root.
    Texts of any length are read turn by turn. Other columns are not read. A conversation is read in order by one task
    and so are the ids that end at one node, as SHA-256 is a chain; neither is ever held whole.
    """
    read = cut(prefixes(rebuilt(conversations, options)))
    finals = read.filter("final").select("node", "conv_id", "depth")
    # Equal conversations go through the trie once, with the smallest id and their number.
    distinct = finals.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.min("depth").alias("length"))
    rows = cut(read.drop("final").join(distinct.drop("node"), "conv_id"))
    nodes = cut(nodes_of(rows).withColumn("layer", layer(F.col("below"), options)))
    # On a conversation's way down the layers fall, so its first node in a layer is the top of its subtree there.
    ways = rows.select("conv_id", "depth", "node").join(nodes.select("node", "layer"), "node")
    tops = ways.groupBy("conv_id", "layer").agg(F.min_by("node", "depth").alias("tree"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = cut(nodes.join(tops, ["conv_id", "layer"]).withColumn("top", F.col("node") == F.col("tree")).join(above, "parent", "left"))
    sizes = {r["layer"]: r["n"] for r in placed.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    done: DataFrame | None = None
    for step in sorted(sizes):
        mine = placed.filter(F.col("layer") == step).select("node", "parent", "tree", "top", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
        if done is None:
            mine = mine.withColumns({n: F.lit(0).cast("long") for n in ("hung_leaves", "hung_saved", "hung")})
        else:
            hanging = done.filter("top").groupBy(F.col("parent").alias("node")).agg(
                F.sum("n_leaves").alias("hung_leaves"), F.sum("saved_tokens").alias("hung_saved"), F.count("*").alias("hung")
            )
            mine = mine.join(hanging, "node", "left").fillna(0, ["hung_leaves", "hung_saved", "hung"])
        parts = max(1, -(-sizes[step] // options.shard_nodes))
        found = cut(shards(mine, parts, done is None, options))
        done = found if done is None else done.unionByName(found)
    if done is None:
        done = shards(placed.select("node", "parent", "tree", "top", *[F.lit(0).cast("long").alias(n) for n in ("own", "hung_leaves", "hung_saved", "hung")]), 1, True, options)
    told = placed.select("node", "conv_id", "depth", "parent_conv_id", "n_convs").join(done.drop("parent", "top"), "node").join(ends_digests(finals), "node", "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
