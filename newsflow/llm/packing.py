"""Best-fit packing with certified repacking.

Each partition packs its pieces by best-fit decreasing and bounds its number of bins from below with dual feasible
functions. A partition that meets its bound is done. The others give the pieces of their unfilled bins to a common
pool, which is dealt anew and packed again; the result is taken if it has fewer bins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import map_batches, texts_of
from newsflow.session import cut


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    #: Name of a vocabulary file that public_tokenizers.path resolves, or a path.
    tokenizer: str = "word_bpe_49k.json"
    #: Id after each document.
    end_id: int = 0
    #: Pieces that one task packs at a time.
    rows_per_task: int = 50_000
    #: Exchanges between partitions that miss their bound.
    rounds: int = 3
    #: Words and parts of words whose ids a worker keeps; beyond it starts anew.
    cached_words: int = 1_200_000


#: Texts of these characters alone are lower-cased, split and looked up word by word; the rest go to the tokenizer whole.
_PLAIN = re.compile(r"[^\t-\r -~¡-©«-±´¶-¸»¿-įı-ſ‐-‧€]")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Words:
    """Token ids by word: in this vocabulary the ids of a word do not depend on its neighbours."""

    def __init__(self, name: str, limit: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab()
        # A text with an added token in it goes to the tokenizer whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.by_word = "word" in name
        self.limit = limit
        #: Ids of words and of their parts; a part that stands alone is a word.
        self.words: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words = {}
        known, split = self.words, {w: _PART.findall(w) for w in words}
        fresh = list({p for parts in split.values() for p in parts if p not in known})
        if fresh:
            ids = np.array(self.tokenizer.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw, at = ids.tobytes(), 0
            for part, end in zip(fresh, cuts.tolist(), strict=True):
                known[part], at = raw[at:end], end
        for word, parts in split.items():
            if len(parts) != 1 or parts[0] != word:
                known[word] = b"".join([known[p] for p in parts])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for text in texts:
            if not self.by_word or _PLAIN.search(text) or any(t in text for t in self.added):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            words = text.lower().split()
            known = self.words
            fresh = {w for w in words if w not in known}
            if fresh:
                if len(known) + len(fresh) > self.limit:
                    fresh = set(words)
                self.learn(fresh)
            yield b"".join(map(self.words.__getitem__, words))


_loaded: dict[tuple, Words] = {}


def encoder(name: str, limit: int) -> Words:
    if (name, limit) not in _loaded:
        _loaded[name, limit] = Words(name, limit)
    return _loaded[name, limit]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, options: Packing = Packing(), keep_ids: bool = False) -> DataFrame:
    """Token pieces of each document, at most `capacity` long; with their ids as little-endian bytes if asked for."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    end = np.array([options.end_id], "<u4").tobytes()
    width = 4 * options.capacity

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = encoder(options.tokenizer, options.cached_words)
        for batch in batches:
            rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        rows["ids"].append(part)
            yield rows

    return map_batches(texts_of(docs), schema, body)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from two families of dual feasible functions over the counts by length."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    volume = counts * sizes
    best = -(-int(volume.sum()) // capacity)
    # Sizes over capacity - e fill a bin, sizes under e vanish, for each e up to half the capacity.
    above, filled = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(volume)])
    e = np.arange(1, capacity // 2 + 1)
    between = filled[capacity - e + 1] - filled[e]
    best = max(best, int((above[np.minimum(capacity - e + 1, capacity)] * (e > 0) + -(-between // capacity)).max(initial=0)))
    # Stair functions with k steps: exact multiples of 1 / (k + 1) keep their size, others round down to 1 / k.
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        stairs = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * stairs).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each piece by best-fit decreasing, and the number of bins.

    Open bins are listed by free space; a bitmask of the sizes in use finds the tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            at, space, count = count, capacity, count + 1
        bins[i], places[i] = at, capacity - space
        left = space - size
        if left:
            free[left].append(at)
            mask |= 1 << left
    return bins, places, count


def _packed(rows: DataFrame, options: Packing, turn: int, parts: int) -> DataFrame:
    """Deal the pieces over `parts` tasks and pack each task's share."""
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, filled long, gap long"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        share = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start", "length")]).combine_chunks()
        lengths = share.column("length").to_numpy()
        bins, places, count = best_fit(lengths, options.capacity)
        gap = count - lower_bound(lengths, options.capacity)
        filled = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        first = (turn << 56) | (TaskContext.get().partitionId() << 32)
        out = {c: share.column(c).combine_chunks() for c in names}
        out |= {"sequence_id": bins + first, "offset": places, "filled": filled[bins], "gap": np.full(len(bins), gap)}
        out = {k: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for k, v in out.items()}
        yield out

    spread: Column = F.xxhash64(F.lit(turn), "doc_id", "piece", "start", "ids_crc32")
    return map_batches(rows.repartition(parts, spread), schema, body)


def pack(rows: DataFrame, options: Packing = Packing()) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces with at most `capacity` tokens each."""
    names = rows.columns
    rows = cut(rows)
    share = lambda n: max(1, -(-n // options.rows_per_task))
    state = cut(_packed(rows, options, 0, share(rows.count())))
    for turn in range(1, options.rounds + 1):
        loose = state.filter((F.col("gap") > 0) & (F.col("filled") < options.capacity))
        before, n = loose.agg(F.sum((F.col("offset") == 0).cast("long")), F.count("*")).first()
        if not n:
            break
        again = cut(_packed(loose.select(*names), options, turn, share(n)))
        after = again.filter("offset = 0").count()
        if after >= before:
            break
        state = cut(state.filter((F.col("gap") <= 0) | (F.col("filled") >= options.capacity)).unionByName(again))
    return state.select(*names, "sequence_id", "offset")


def packed(docs: DataFrame, options: Packing = Packing(), keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of (doc_id, text), with its sequence and place.

    A null or empty text is one piece that holds the end id alone. Documents longer than the capacity are cut,
    others never. Repeated rows are packed as often as they occur, a null id is kept, an empty table gives no
    rows. Special tokens in a text become their ids, as in a plain call of the tokenizer. Other columns are not read.
    """
    return pack(pieces(docs, options, keep_ids), options)
