"""Repeated strings by a hash-compared suffix sort.

A string of `length` bytes that occurs twice contains the same anchor, its least 32-byte gram, at the same place. So
occurrences are dealt by their anchor's hash, and only anchors that occur twice go on, with the bytes of the strings
around them. What follows and what precedes the anchors of one group is sorted: a mergesort whose comparisons find
the common extension of two suffixes by binary search over prefix polynomial hashes. Two strings are equal if both
their parts fall into one run of the sorted orders. The extensions are then compared byte by byte; should hashes
have collided, the chunk is sorted by its bytes.

Texts that are equal as a whole are looked at once; they are stored bucketed, so that no later join moves them.
Occurrences of a crowded anchor first meet as hashes of all their bytes, where copies fall together; what is left of
a crowd is dealt by finer keys: the bytes common to eight neighbouring strings, and if need be to one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import BLOCK, U64, bitmap, byte_rows, in_bitmap, map_batches, mix, prefix_hashes, span_hashes, texts_of
from newsflow.session import cut, fresh_path

LENGTH = 200
GRAM = 32
#: Occurrences above which an anchor is a crowd.
CROWD = 512
#: Neighbouring strings that share a key, by level of refinement.
FINER = (8, 1)
#: Contexts sorted at a time; a group is never cut.
CHUNK = 6_000


def anchors_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: first start, anchor's distance from it, strings, anchor's hash.

    Works on blocks of the text, so a run may come in two parts.
    """
    strings = len(raw) - LENGTH + 1
    wide = LENGTH - GRAM + 1
    parts = []
    for at in range(0, max(strings, 0), BLOCK):
        n = min(BLOCK, strings - at)
        prefix = prefix_hashes(raw[at : at + n + LENGTH - 1])
        first = np.arange(n + wide - 1)
        grams = mix(span_hashes(prefix, first, first + GRAM))
        keys = (grams & U64(0xFFFFFFFF00000000)) | first.astype(U64)
        # Least key of each window of `wide` grams: from the window's left part of one block of keys and right part of the next.
        padded = np.full(-(-len(keys) // wide) * wide, U64(0xFFFFFFFFFFFFFFFF))
        padded[: len(keys)] = keys
        tiles = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
        parts.append((starts + at, place - starts, np.diff(np.append(starts, n)), grams[place]))
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.view(U64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pack(start: np.ndarray, before: np.ndarray, strings: np.ndarray) -> np.ndarray:
    return (start << 16) | (before << 8) | strings


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 16, (packed >> 8) & 255, packed & 255


def first_keys(texts: DataFrame, held: np.ndarray | None = None) -> DataFrame:
    """(digest, key, place) of each run of strings; place packs start, distance of the anchor and number of strings.

    With a bitmap of keys only runs whose key may be among them.
    """
    shared = None if held is None else texts.sparkSession.sparkContext.broadcast(held)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, raw in enumerate(byte_rows(batch.column(1))):
                if len(raw) >= LENGTH:
                    start, before, strings, grams = anchors_of(raw)
                    place = _pack(start, before, strings)
                    if shared is not None:
                        likely = in_bitmap(shared.value, grams)
                        place, grams = place[likely], grams[likely]
                    rows.append(np.full(len(place), i))
                    keys.append(grams.view(np.int64))
                    places.append(place)
            yield {"digest": batch.column(0).take(pa.array(np.concatenate(rows))), "key": np.concatenate(keys), "place": np.concatenate(places)}

    return map_batches(texts.select("digest", "text"), "digest binary, key long, place long", body)


def marked_texts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(digest, text, copies, marks) of texts with marks; a text's marks are bounded by its length."""
    own = marks.groupBy("digest").agg(F.collect_list(F.struct("key", "place")).alias("marks"))
    return texts.join(own, "digest")


def _marks(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    held = column[i].values
    return held.field(0).to_numpy(), held.field(1).to_numpy()


def finer_keys(marked: DataFrame, size: int) -> DataFrame:
    """Deal runs by `size` neighbouring strings at a time: the key is the bytes that these strings share."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, raw in enumerate(byte_rows(batch.column(1))):
                _, place = _marks(batch.column(3), i)
                start, before, strings = _unpack(place)
                # A string's number is its anchor's distance from its start: the same for equal strings.
                low, high = (before - strings + 1) // size, before // size
                count = high - low + 1
                run = np.repeat(np.arange(len(place)), count)
                part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[run]
                top = np.minimum(before[run], part * size + size - 1)
                bottom = np.maximum(before[run] - strings[run] + 1, part * size)
                anchor = start[run] + before[run]
                # Each string of a part holds the bytes that all strings of a whole part have in common.
                first, end = anchor - part * size, anchor - (part * size + size - 1) + LENGTH
                shared = mix(span_hashes(prefix_hashes(raw), first, end) + part.astype(U64))
                rows.append(np.full(len(run), i))
                keys.append(shared.view(np.int64))
                places.append(_pack(anchor - top, top, top - bottom + 1))
            yield {"digest": batch.column(0).take(pa.array(np.concatenate(rows))), "key": np.concatenate(keys), "place": np.concatenate(places)}

    return map_batches(marked, "digest binary, key long, place long", body)


def context_ids(marked: DataFrame) -> DataFrame:
    """(digest, key, place, context_id): a 128-bit hash of the bytes of each run, its key and its anchor's place."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, keys, places, ids = [], [], [], []
            for i, view in enumerate(byte_rows(batch.column(1))):
                raw = view.tobytes()
                key, place = _marks(batch.column(3), i)
                for k, p, a, b, n in zip(key.tolist(), place.tolist(), *(x.tolist() for x in _unpack(place)), strict=True):
                    rows.append(i)
                    keys.append(k)
                    places.append(p)
                    salt, person = (k & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), b.to_bytes(8, "little")
                    ids.append(hashlib.blake2b(raw[a : a + n + LENGTH - 1], digest_size=16, salt=salt, person=person).digest())
            yield {"digest": batch.column(0).take(pa.array(rows, pa.int64())), "key": keys, "place": places, "context_id": ids}

    return map_batches(marked, "digest binary, key long, place long, context_id binary", body)


def contexts(marked: DataFrame) -> DataFrame:
    """(key, digest, start, before, context): the bytes of each run of strings."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows, out = [], {k: [] for k in ("key", "start", "before", "context")}
            for i, view in enumerate(byte_rows(batch.column(1))):
                raw = view.tobytes()
                key, place = _marks(batch.column(3), i)
                start, before, strings = _unpack(place)
                out["key"] += key.tolist()
                out["start"] += start.tolist()
                out["before"] += before.tolist()
                out["context"] += [raw[a : a + n + LENGTH - 1] for a, n in zip(start.tolist(), strings.tolist(), strict=True)]
                rows += [i] * len(place)
            yield out | {"digest": batch.column(0).take(pa.array(rows, pa.int64()))}

    return map_batches(marked, "key long, digest binary, start long, before int, context binary", body)


PLACE = "digest", "key", "place"


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs to sort, no key being a crowd, and runs (digest, place) known to repeat as a whole."""

    def twice(keyed: DataFrame) -> DataFrame:
        return keyed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")

    times = cut(twice(first_keys(texts)))
    marks = cut(first_keys(texts, bitmap(times, F.col("key"))).join(times, "key"))
    to_sort, whole = [], []
    for size in (*FINER, None):
        to_sort.append(marks.filter(F.col("times") <= CROWD).select(*PLACE))
        crowd = marks.filter(F.col("times") > CROWD)
        if crowd.isEmpty():
            break
        # Equal runs meet as hashes; one of each goes on, as it may hold strings that other runs hold.
        ids = cut(context_ids(marked_texts(texts, crowd)))
        equal = ids.groupBy("context_id").agg(F.count("*").alias("copies"), F.first("key").alias("key"), F.min(F.struct("digest", "place")).alias("one"))
        equal = cut(equal)
        # A merge join, as its hot keys can be split when it runs.
        again = equal.filter("copies > 1").select("context_id").hint("merge")
        whole.append(ids.join(again, "context_id").select("digest", "place"))
        if size is None:
            break
        ones = equal.select("one.digest", "key", "one.place")
        different = cut(ones.join(twice(ones), "key"))
        to_sort.append(different.filter(F.col("times") <= CROWD).select(*PLACE))
        finer = cut(finer_keys(marked_texts(texts, different.filter(F.col("times") > CROWD)), size))
        marks = cut(finer.join(twice(finer), "key"))
    first = to_sort[0]
    for more in to_sort[1:]:
        first = first.unionByName(more)
    known = whole[0] if whole else marks.select("digest", "place").limit(0)
    for more in whole[1:]:
        known = known.unionByName(more)
    return first, known


class Suffixes:
    """Suffixes buf[start : start + size] that compare by hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.buf, self.start, self.size, self.prefix = buf, start, size, prefix_hashes(buf)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search."""
        sa, sb = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hashes(self.prefix, sa, sa + mid) == span_hashes(self.prefix, sb, sb + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        ended = n == self.size[a]
        last = len(self.buf) - 1
        smaller = self.buf[np.minimum(self.start[a] + n, last)] < self.buf[np.minimum(self.start[b] + n, last)]
        return np.where(ended, n < self.size[b], (n < self.size[b]) & smaller)

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within each group, groups being contiguous, and common length with the one before (0 for a group's first)."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
        members = np.diff(np.append(first, n))
        begin = np.repeat(first, members)
        end = begin + np.repeat(members, members)
        order, width = np.arange(n), 1
        while n and width < members.max():
            at = np.flatnonzero(end - begin > width)
            own = at - begin[at]
            run = own // width
            odd = run % 2 == 1
            pair = begin[at] + (run - odd) * width
            # Rank in the sibling run: smaller ones for the left run, smaller or equal ones for the right.
            low = np.minimum(np.where(odd, pair, pair + width), end[at])
            base, high = low.copy(), np.minimum(np.where(odd, pair + width, pair + 2 * width), end[at])
            item = order[at]
            while len(todo := np.flatnonzero(low < high)):
                mid = (low[todo] + high[todo]) >> 1
                x, y, right = order[mid], item[todo], odd[todo]
                swap = self.less(np.where(right, y, x), np.where(right, x, y))
                go = np.where(right, ~swap, swap)
                low[todo], high[todo] = np.where(go, mid + 1, low[todo]), np.where(go, high[todo], mid)
            merged = order.copy()
            merged[pair + (own - run * width) + (low - base)] = item
            order, width = merged, 2 * width
        shared = np.zeros(n, np.int64)
        inner = np.flatnonzero(np.arange(n) != begin) if n else np.empty(0, np.int64)
        if len(inner):
            shared[inner] = self.common(order[inner - 1], order[inner])
            if not self.verified(order[inner - 1], order[inner], shared[inner]):
                return self.by_bytes(begin, order, inner)
        return order, shared

    def verified(self, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> bool:
        """True if the bytes agree as far as the hashes say, and order the pair there."""
        for at in range(0, len(a), 4096):
            x, y, n = a[at : at + 4096], b[at : at + 4096], shared[at : at + 4096]
            step = np.arange(int(n.max()))
            inside = step < n[:, None]
            last = len(self.buf) - 1
            same = self.buf[np.minimum(self.start[x][:, None] + step, last)] == self.buf[np.minimum(self.start[y][:, None] + step, last)]
            if not (same | ~inside).all():
                return False
            over = n == self.size[x]
            if not (over | ((n < self.size[y]) & (self.buf[np.minimum(self.start[x] + n, last)] < self.buf[np.minimum(self.start[y] + n, last)]))).all():
                return False
        return True

    def by_bytes(self, begin: np.ndarray, order: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing bytes, for the case of a collision."""
        held = [self.buf[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        order = np.array(sorted(range(len(order)), key=lambda i: (begin[i], held[i])), np.int64)
        shared = np.zeros(len(order), np.int64)
        for i in inner.tolist():
            a, b = held[order[i - 1]], held[order[i]]
            shared[i] = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        return order, shared


def repeated_strings(group: np.ndarray, before: np.ndarray, held: list[bytes]) -> list[list[int]]:
    """For each context, groups being contiguous: first and end of each run of string starts that occur twice."""
    size = np.array([len(c) for c in held])
    strings = size - LENGTH + 1
    start = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(held), np.uint8)
    after_order, after = Suffixes(buf, start + before, size - before).sorted(group)
    ahead_order, ahead = Suffixes(buf[::-1], len(buf) - (start + before), before).sorted(group)
    n = len(held)
    found: list[list[np.ndarray]] = [[], []]
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(int((before - strings + 1).min()), int(before.max()) + 1):
        with_it = np.flatnonzero((distance <= before) & (distance > before - strings))
        right[after_order] = np.cumsum(after < LENGTH - distance)
        left[ahead_order] = np.cumsum(ahead < distance)
        key = right[with_it] * (n + 1) + left[with_it]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(with_it), np.bool_)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found[0].append(with_it[twice])
        found[1].append(before[with_it[twice]] - distance)
    rows, starts = (np.concatenate(f) for f in found)
    out: list[list[int]] = [[] for _ in range(n)]
    if not len(rows):
        return out
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(rows)) - 1
    for r, a, b in zip(rows[first].tolist(), starts[first].tolist(), starts[last].tolist(), strict=True):
        out[r] += [a, b + 1]
    return out


def sorted_spans(around: DataFrame) -> DataFrame:
    """(digest, first, end) of bytes covered by strings that occur twice, from contexts dealt by their key."""

    def solve(part: pa.Table) -> dict:
        key, before = part.column("key").to_numpy(), part.column("before").to_numpy().astype(np.int64)
        start = part.column("start").to_numpy()
        found = repeated_strings(key, before, part.column("context").to_pylist())
        rows = np.repeat(np.arange(len(found)), [len(f) // 2 for f in found])
        runs = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
        digests = part.column("digest").combine_chunks()
        return {"digest": digests.take(pa.array(rows)), "first": start[rows] + runs[:, 0], "end": start[rows] + runs[:, 1] + LENGTH - 1}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                ready = int(np.searchsorted(keys, keys[-1], "left"))
                if ready:
                    for at in _chunks(keys[:ready]):
                        yield solve(table.slice(*at))
                    held = table.slice(ready).to_batches()
                    rows -= ready
        if rows:
            table = pa.Table.from_batches(held)
            for at in _chunks(table.column("key").to_numpy()):
                yield solve(table.slice(*at))

    return map_batches(around.repartition("key").sortWithinPartitions("key"), "digest binary, first long, end long", body)


def _chunks(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(offset, rows) of parts of about CHUNK rows that end with a key."""
    at = 0
    while at < len(keys):
        end = min(at + CHUNK, len(keys))
        end = int(np.searchsorted(keys, keys[end - 1], "right"))
        yield at, end - at
        at = end


def removed(marked: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) from (digest, text, copies, spans)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("digest", "n_removed", "n_spans", "kept_sha256")}
            for i, view in enumerate(byte_rows(batch.column(1))):
                kept, gone, spans = keep(view.tobytes(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                out["n_removed"].append(gone)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield out | {"digest": batch.column(0)}

    return map_batches(marked, "digest binary, n_removed long, n_spans long, kept_sha256 string", body)


def keep(raw: bytes, copies: int, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """Bytes left, bytes removed and maximal removed runs. A text that occurs twice as a whole is one run."""
    if copies > 1 and len(raw) >= LENGTH:
        return b"", len(raw), 1
    out, at, gone, runs = [], 0, 0, 0
    last = -1
    for first, end in sorted((s["first"], s["end"]) for s in spans or ()):
        runs += first > last
        out.append(raw[at : max(at, first)])
        gone += max(0, end - max(at, first))
        at = last = max(at, end)
    return b"".join([*out, raw[at:]]), gone, runs


def unique_texts(docs: DataFrame) -> DataFrame:
    """(digest, text, copies) of each distinct text, as a table in buckets of digests. Equal texts meet map side first."""
    spark = docs.sparkSession
    rows = texts_of(docs).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    rows = rows.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, buckets = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "digest").option("path", fresh_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(digest, spans) of bytes covered by a string of LENGTH bytes that also starts elsewhere in another distinct text or place."""
    to_sort, whole = candidates(texts)
    found = sorted_spans(contexts(marked_texts(texts, to_sort)))
    start, strings = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    known = whole.select("digest", start.alias("first"), (start + strings + (LENGTH - 1)).alias("end"))
    return found.unionByName(known).groupBy("digest").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of LENGTH bytes that also starts anywhere else, in the same text or
    another; matches do not cross texts. A null text is an empty one. Repeated rows and null ids are kept; a repeated
    text of LENGTH bytes or more goes as a whole. Other columns are not read.
    """
    texts = unique_texts(docs)
    solved = cut(removed(texts.join(repeated_spans(texts), "digest", "left").select("digest", "text", "copies", "spans")))
    rows = texts_of(docs).select(
        "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    return rows.join(solved, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
