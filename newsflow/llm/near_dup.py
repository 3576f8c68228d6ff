"""HyperMinHash near-duplicates: compressed registers, banding, corrected estimates, and exact verification.

A document's shingle hashes are dealt over buckets; a bucket's register keeps the leading-zero count and a few
mantissa bits of its least hash. Registers in bands propose pairs, the estimate of Jaccard similarity corrected for
chance collisions sorts them out, and full shingle sets confirm every link.

Documents with equal shingle sets are one class. In each band bucket all classes are compared with one centre, the
class that shares most buckets, which joins a group of copies in as many comparisons as it has members. Classes of a
centre that are then still apart are compared with each other in blocks: registers tell which of them may have a
link at all, and a product of their set matrices finds the links; a task hands on no more links than join its labels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import LOWER, U64, bitmap, byte_rows, gram_hashes, in_bitmap, map_batches, mix, texts_of, word_hashes, word_spans
from newsflow.session import cut


@dataclass(frozen=True)
class NearDuplicates:
    #: Words of a shingle.
    words: int = 5
    #: Linked from this Jaccard similarity, in per cent.
    percent: int = 80
    #: Bits of the bucket number: 2^7 registers.
    bucket_bits: int = 7
    mantissa_bits: int = 10
    #: Registers of a band; 32 bands of 4 miss a pair at 0.8 with chance 5e-8.
    band_registers: int = 4
    #: Standard errors by which an estimate may fall short of the similarity.
    slack: float = 5.0
    #: Classes of one centre on either side of a comparison, by registers and by sets.
    block: int = 512
    set_block: int = 256

    @property
    def registers(self) -> int:
        return 1 << self.bucket_bits


EMPTY = np.uint16(0xFFFF)


def shingles(raw: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    low = LOWER[raw]
    starts, ends = word_spans(low)
    return np.unique(gram_hashes(word_hashes(low, starts, ends), words))


def registers_of(hashes: np.ndarray, options: NearDuplicates) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's least hash, from sorted hashes."""
    out = np.full(options.registers, EMPTY, np.uint16)
    bucket = (hashes >> U64(64 - options.bucket_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = hashes[first] << U64(options.bucket_bits)
    zeros = np.clip(64 - np.frexp(rest.astype(np.float64))[1], 0, 62)
    mantissa = (rest << (zeros + 1).astype(U64)) >> U64(64 - options.mantissa_bits)
    out[bucket[first]] = (zeros << options.mantissa_bits) + mantissa.astype(np.int64)
    return out


def bands_of(registers: np.ndarray, options: NearDuplicates) -> np.ndarray:
    """A key per band. An empty register borrows the next that is not, marked by the distance."""
    held = np.flatnonzero(registers != EMPTY)
    m = len(registers)
    after = np.searchsorted(held, np.arange(m))
    source = np.where(after < len(held), held[after % len(held)], held[0] + m)
    dense = registers[source % m].astype(U64) + ((source - np.arange(m)).astype(U64) << U64(16))
    rows = dense.reshape(-1, options.band_registers)
    key = np.arange(len(rows), dtype=U64)
    for k in range(options.band_registers):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, k] + U64(1))
    return key.view(np.int64)


def chance_collisions(a: np.ndarray, b: np.ndarray, options: NearDuplicates) -> np.ndarray:
    """Chance that the registers of unrelated sets of each two sizes agree."""
    k = np.arange(64 - options.bucket_bits)[:, None]

    def zeros(sizes: np.ndarray) -> np.ndarray:
        load = sizes[None, :] / options.registers
        return np.exp(-load * 2.0 ** -(k + 1)) - np.exp(-load * 2.0**-k)

    return zeros(a).T @ zeros(b) * 2.0**-options.mantissa_bits


def estimates(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, options: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    """Corrected similarity of each two register rows, and the registers that tell."""
    same, none = np.empty((len(a), len(b))), np.empty((len(a), len(b)))
    empty_a, empty_b = (a == EMPTY), (b == EMPTY)
    for i in range(len(a)):
        both = empty_b & empty_a[i]
        none[i] = both.sum(axis=1)
        same[i] = (b == a[i]).sum(axis=1) - none[i]
    used = options.registers - none
    p = chance_collisions(sizes_a.astype(float), sizes_b.astype(float), options)
    return (same / np.maximum(used, 1) - p) / (1 - p), used


def may_link(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, options: NearDuplicates) -> np.ndarray:
    """False where sizes or estimates rule a link out."""
    floor = options.percent / 100
    estimate, used = estimates(a, sizes_a, b, sizes_b, options)
    small, large = np.minimum(sizes_a[:, None], sizes_b), np.maximum(sizes_a[:, None], sizes_b)
    return (100 * small >= options.percent * large) & (estimate >= floor - options.slack * np.sqrt(floor * (1 - floor) / np.maximum(used, 1)))


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """(doc_id, text_id, n_shingles, key) of each row; registers and bands with the first row of a key in a task."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("text_id", "n_shingles", "key", "registers", "bands")}
            for raw in byte_rows(batch.column(1)):
                out["text_id"].append(hashlib.sha256(raw).digest())
                found = shingles(raw, options.words)
                key = _key(found) if len(found) else None
                fresh = key is not None and key not in seen
                if fresh:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                held = registers_of(found, options) if fresh else None
                out["n_shingles"].append(len(found))
                out["key"].append(key)
                out["registers"].append(held.tobytes() if fresh else None)
                out["bands"].append(bands_of(held, options).tolist() if fresh else None)
            yield out | {"doc_id": batch.column(0)}

    return map_batches(texts_of(docs), "doc_id long, text_id binary, n_shingles long, key binary, registers binary, bands array<long>", body)


def shingle_sets(docs: DataFrame, keys: DataFrame, options: NearDuplicates) -> DataFrame:
    """(key, hashes) for the given keys, by a second pass over the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(keys, F.xxhash64("key")))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, seen = wanted.value, set()
        for batch in batches:
            out: dict[str, list] = {"key": [], "hashes": []}
            for raw in byte_rows(batch.column(1)):
                found = shingles(raw, options.words)
                key = _key(found)
                if len(found) and key not in seen and in_bitmap(held, np.array([xxhash.xxh64_intdigest(key, 42)], U64))[0]:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    out["key"].append(key)
                    out["hashes"].append(found.tobytes())
            yield out

    sets = map_batches(texts_of(docs), "key binary, hashes binary", body).join(keys, "key", "left_semi")
    return cut(sets.groupBy("key").agg(F.first("hashes").alias("hashes")))


def confirmed(pairs: DataFrame, docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """The pairs (a, b) of keys whose full sets are similar enough."""
    keys = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    sets = shingle_sets(docs, keys, options)
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hashes_b"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if 100 * min(len(x), len(y)) < options.percent * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= options.percent * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            yield out

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b")
    return cut(map_batches(both, "a binary, b binary", body))


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the least key of each component, for keys that have an edge. Alternates large and small stars."""

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = sign(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(small.distinct())
        if (after := sign(now)) == before:
            break
        before = after
    roots = now.select(F.col("v").alias("key")).distinct()
    return now.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(roots.select("key", F.col("key").alias("label")))


def likely(stars: DataFrame, classes: DataFrame, options: NearDuplicates) -> DataFrame:
    """The pairs whose sizes and registers allow a link."""
    known = classes.select("key", "n_shingles", "registers")
    both = stars.join(known.toDF("a", "size_a", "registers_a"), "a").join(known.toDF("b", "size_b", "registers_b"), "b")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = range(batch.num_rows)
            a, b = (np.array([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()]).reshape(-1, options.registers) for c in (3, 5))
            size_a, size_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            at = [i for i in rows if may_link(a[i : i + 1], size_a[i : i + 1], b[i : i + 1], size_b[i : i + 1], options)[0, 0]]
            yield {"a": batch.column(0).take(pa.array(at, pa.int64())), "b": batch.column(1).take(pa.array(at, pa.int64()))}

    return cut(map_batches(both.select("a", "b", "size_a", "registers_a", "size_b", "registers_b"), "a binary, b binary", body))


TILE = ("center", "i", "j")


def tiles(members: DataFrame, block: int) -> DataFrame:
    """Deal the members (center, key, label, ...) of each centre over pairs of blocks.

    Members of its most common label have no need to meet each other, so their blocks meet only those of the rest.
    """
    labels = members.groupBy("center", "label").agg(F.count("*").alias("n"))
    main = labels.groupBy("center").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    main = main.filter(F.col("all") > F.col("top.n")).select("center", F.col("top.label").alias("main"), F.col("top.n").alias("mains"), (F.col("all") - F.col("top.n")).alias("others"))
    rows = members.join(main, "center")
    is_main = F.col("label") == F.col("main")
    rows = rows.withColumn("m", F.ceil(F.col("mains") / block)).withColumn("o", F.ceil(F.col("others") / block))
    spread = F.xxhash64("key")
    rows = rows.withColumn("own", F.when(is_main, F.col("o") + F.pmod(spread, "m")).otherwise(F.pmod(spread, "o")).cast("int"))
    last = F.when(is_main, F.col("o")).otherwise(F.col("o") + F.col("m")).cast("int") - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.drop("main", "mains", "others", "m", "o", "other").repartition(*TILE).sortWithinPartitions(*TILE)


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and any(row[c] != group[0][c] for c in TILE):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _sides(group: list[dict]) -> tuple[list[dict], list[dict]]:
    first = [r for r in group if r["own"] == group[0]["i"]]
    return first, first if group[0]["i"] == group[0]["j"] else [r for r in group if r["own"] != group[0]["i"]]


def _apart(a: list[dict], b: list[dict]) -> np.ndarray:
    number = {x: i for i, x in enumerate({r["label"] for r in a + b})}
    return np.array([number[r["label"]] for r in a])[:, None] != np.array([number[r["label"]] for r in b])


def hopeful(members: DataFrame, options: NearDuplicates) -> DataFrame:
    """Members (center, key) that may have a link to one of another label, by registers."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in by_tile(batches):
            a, b = _sides(group)
            if not a or not b:
                continue
            held = [np.array([np.frombuffer(r["registers"], np.uint16) for r in side]) for side in (a, b)]
            sizes = [np.array([r["n_shingles"] for r in side]) for side in (a, b)]
            found = may_link(held[0], sizes[0], held[1], sizes[1], options) & _apart(a, b)
            keys = {a[i]["key"] for i in np.flatnonzero(found.any(axis=1))} | {b[i]["key"] for i in np.flatnonzero(found.any(axis=0))}
            yield {"center": [group[0]["center"]] * len(keys), "key": sorted(keys)}

    return cut(map_batches(tiles(members, options.block), "center binary, key binary", body).distinct())


def common_sizes(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each two sets, as a product of their matrices taken over parts of the columns."""
    values = np.concatenate([*a, *b])
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, (first, first + columns))
        part = np.zeros((len(a) + len(b), columns), np.float32)
        part[rows[lo:hi], column[lo:hi] - first] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def joining_links(members: DataFrame, options: NearDuplicates) -> DataFrame:
    """Confirmed links (a, b) between members of one centre, as many as join the labels of a tile."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in by_tile(batches):
            a, b = _sides(group)
            if not a or not b:
                continue
            sets = [[np.frombuffer(r["hashes"], U64) for r in side] for side in (a, b)]
            sizes = [np.array([len(x) for x in side]) for side in sets]
            common = common_sizes(*sets)
            linked = 100 * common >= options.percent * (sizes[0][:, None] + sizes[1] - common)
            root: dict[bytes, bytes] = {}

            def find(x: bytes, root: dict = root) -> bytes:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            out: dict[str, list] = {"a": [], "b": []}
            for x, y in zip(*np.nonzero(linked & _apart(a, b)), strict=True):
                p, q = find(a[x]["label"]), find(b[y]["label"])
                if p != q:
                    root[p] = q
                    out["a"].append(a[x]["key"])
                    out["b"].append(b[y]["key"])
            yield out

    return cut(map_batches(tiles(members, options.set_block), "a binary, b binary", body))


def near_duplicates(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of (doc_id, text): n_shingles, component_id, kept.

    component_id is the smallest id among the documents that links lead to, itself included; a text without words
    has none but itself. Repeated rows share their component; a null id has the component of its text and is kept only
    if no other id is in it, which for texts without words is always. Other columns are not read.
    """
    return classed(docs, options).select("doc_id", "n_shingles", "component_id", "kept")


def classed(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """(doc_id, text_id, n_shingles, label, component_id, kept) of each row; the label names the component, null without words."""
    rows = cut(signatures(docs, options))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"),
        F.first("bands", ignorenulls=True).alias("bands"),
    )
    classes = cut(classes)
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    members = cut(banded.join(buckets, "band"))
    popular = members.groupBy("key").agg(F.sum("members").alias("popularity"))
    ranked = cut(members.join(popular, "key"))
    centers = ranked.groupBy("band").agg(F.max(F.struct("popularity", "key")).alias("top")).select("band", F.col("top.key").alias("center"))
    grouped = cut(ranked.join(centers, "band").filter("key <> center").select("center", "key").distinct())
    edges = confirmed(likely(grouped.toDF("a", "b"), classes, options), docs, options)
    labels = cut(components(edges))
    labelled = cut(grouped.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    hope = hopeful(labelled.join(classes.select("key", "n_shingles", "registers"), "key"), options)
    if not hope.isEmpty():
        sets = shingle_sets(docs, cut(hope.select("key").distinct()), options)
        links = joining_links(labelled.join(hope, ["center", "key"]).join(sets, "key"), options)
        labels = cut(components(edges.unionByName(links)))
    named = classes.select("key", "least_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = cut(named.join(least, "label").select("key", "label", "component_id"))
    out = rows.select("doc_id", "text_id", "n_shingles", "key").join(found, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_id", "n_shingles", "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of documents, all their columns, with one document of each component: that with the smallest id.

    If that id has several texts in the component, the text with the smallest SHA-256 stays; an id with texts in
    several components is judged in each. Of repeated rows of one id and text one stays. Rows without words and rows
    without an id stay.
    """
    marks = cut(classed(docs, options).filter("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_id", "label", "kept"))
    first = marks.filter("kept").groupBy("label").agg(F.min("text_id").alias("first_text"))
    others = marks.filter("kept").join(first, "label").filter("text_id <> first_text").select("doc_id", "text_id")
    gone = marks.filter("NOT kept").select("doc_id", "text_id").unionByName(others).distinct().toDF("gone_id", "gone_text")
    text_id = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.struct("*").alias("document"), F.col("doc_id").alias("own_id"), text_id.alias("own_text"), F.col("text").isNull().alias("no_text"))
    left = rows.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_text") == F.col("gone_text")), "left_anti")
    # Dealt by id and text already, so this needs no further shuffle.
    return left.dropDuplicates(["own_id", "own_text", "no_text"]).select("document.*")
