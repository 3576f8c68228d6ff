"""Extendible hashing: a directory over the leading bits of a hash, where only buckets over the limit split.

A document's shard is the shortest prefix of its hash whose documents fit the limit, which is what splitting one
bucket at a time on its next bit arrives at. Byte sums per prefix replace the splitting itself: a round sums the
open buckets over the next bits, settles those that fit and goes on with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.session import cut

#: Bits of a hash that come from the document, and beyond them from the row's place among equal documents.
CONTENT_BITS, ROW_BITS = 64, 64
#: Bits that one round looks at.
STEP = 8


def bits_of(hashed: str) -> Column:
    """64 characters 0 and 1 from the first 16 digits of a hexadecimal string."""
    half = lambda at: F.lpad(F.conv(F.substring(hashed, at, 8), 16, 2), 32, "0")
    return F.concat(half(1), half(9))


def directory(docs: DataFrame, max_bytes: int) -> DataFrame:
    """Each row of (doc_id, text) with its size, its shard's prefix, depth and bytes.

    The hash is that of the id and, for rows without one, of the text. Rows that agree in it are told apart by
    their text and, if that agrees too, by their place in the input, so that no set of copies is stuck in one
    bucket. A document over the limit ends alone at the full depth and is marked. A null text has no bytes; an empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")).cast("binary")).alias("a"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("b"),
        F.md5(F.monotonically_increasing_id().cast("string").cast("binary")).alias("c"),
    )
    open_rows = cut(rows.select("doc_id", "n_bytes", F.concat(bits_of("a"), bits_of("b"), bits_of("c")).alias("bits")))
    deepest = 2 * CONTENT_BITS + ROW_BITS
    done, depth = [], 0
    while True:
        last = min(depth + STEP - 1, deepest)
        fine = open_rows.groupBy(F.expr(f"substring(bits, 1, {last})").alias("fine")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = fine.select("fine", "bytes", "rows", F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth"))
        sums = levels.groupBy("depth", F.expr("substring(fine, 1, depth)").alias("shard")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")
        )
        fits = sums.filter((F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1) | (F.col("depth") == deepest))
        reach = levels.select("fine", "depth", F.expr("substring(fine, 1, depth)").alias("shard")).join(fits, ["depth", "shard"])
        leaf = cut(reach.groupBy("fine").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf")))
        settled = open_rows.join(leaf.withColumn("found", F.lit(True)), F.expr(f"substring(bits, 1, {last})") == F.col("fine"), "left")
        settled = cut(settled.select("doc_id", "n_bytes", "bits", "found", "leaf"))
        done.append(settled.filter("found").select("doc_id", "n_bytes", "leaf.*"))
        open_rows = settled.filter("found IS NULL").select("doc_id", "n_bytes", "bits")
        if last == deepest or open_rows.isEmpty():
            break
        depth = last + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), F.col("shard_bytes").cast("long").alias("shard_bytes"),
        (F.col("shard_bytes") > max_bytes).alias("oversized"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents below one folder per shard; ids must be unique and not null here."""
    rows = docs.join(placed.select("doc_id", "shard"), "doc_id")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
