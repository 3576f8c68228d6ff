"""Helpers that several operators share: whole-table reads, Arrow batches, word hashes, fixed-size bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd base of the polynomial hashes modulo 2^64 and its inverse there.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time, so that the tables of powers stay small however long a text is.
BLOCK = 1 << 20
#: Bits of the bitmaps that prefilter a shuffle: two megabytes, whatever the input's size.
BITMAP_BITS = 1 << 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, *others: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns cannot clash; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)


def map_batches(df: DataFrame, schema: str | StructType, body: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow for a body that yields plain dictionaries of columns."""
    types = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type, from_pandas=False) for f in arrow],
                schema=arrow,
            )

    return df.mapInArrow(run, types)


_made: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What `make` returns, kept by a worker from task to task; a new name drops the old ones of its kind."""
    if name not in _made:
        for old in [k for k in _made if k.split(":")[0] == name.split(":")[0]]:
            del _made[old]
        _made[name] = make()
    return _made[name]


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value, without decoding or copying; a null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield held[0:0] if missing[i] else held[at[i] : at[i + 1]]


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and INVERSE^i for i up to n, modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << max(12, (n + 1).bit_length())
        made = []
        for base in (BASE, INVERSE):
            steps = np.full(size, U64(base))
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _powers = (made[0], made[1])
    return _powers


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] times BASE^s the polynomial hash of raw[s:e]; see span_hashes."""
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(len(raw))[1][: len(raw)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[0][starts]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Word characters under [^\x20\x09-\x0D], and under letters, digits and all that is not ASCII.
NOT_BLANK = np.ones(256, np.bool_)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(256)], np.bool_)
#: Lower case for A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, chars: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = chars[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over blocks of words."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        prefix = prefix_hashes(raw[first : ends[j - 1]])
        out[i:j] = span_hashes(prefix, starts[i:j] - first, ends[i:j] - first)
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; of all of them if there are fewer; none without words."""
    n = min(n, len(words))
    if not n:
        return words
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h) * U64(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k]
    return mix(h + U64(n))


def bitmap(keys: DataFrame, key: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit for each key's place, as bytes of a size fixed beforehand. Only a prefilter: other keys may share a bit."""
    place = F.pmod(key, F.lit(bits)).alias("place")
    rows = (
        keys.select(place)
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    # Bucket b holds the places 32768 (b - 1) + 1 .. 32768 b, and bucket 0 those below 1.
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in rows:
        held = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = 4096 * int(r["bucket"])
        out[at : at + len(held)] |= held
    return out


def in_bitmap(held: np.ndarray, keys: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    place = (keys.view(np.int64) % np.int64(bits)).astype(np.int64)
    bucket = np.where(place > 0, 1 + (place - 1) // 32768, place // 32768)
    bit = np.where(place > 0, (place - 1) % 32768, -place % 32768)
    return (held[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1
