"""How far the sources of a language diverge in their terms, by a three-dimensional cube of tasks.

The sources of a language are dealt into group blocks and its terms into term blocks. A task owns a cell (group block,
group block, term block): it gets the counts of both group blocks in that term block, replicated from their slices,
and computes the partial divergence of every ordered pair of their sources. Partial sums are reduced along the terms.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import map_batches
from newsflow.session import cut


@dataclass(frozen=True)
class Cube:
    #: Documents of a language in which a term must occur.
    least_documents: int = 3
    #: Terms listed for each source.
    terms: int = 200
    #: Sources in a group block and terms in a term block, about: blocks are dealt by hash.
    group_block: int = 64
    term_block: int = 8192
    #: Bytes of texts that a counting task takes at a time; a longer text is taken alone.
    batch_bytes: int = 3 << 20
    #: Counts that it holds before it adds them up.
    held_terms: int = 1_000_000


#: Parts of the unit that a probability is counted in.
UNIT = 1_000_000_000
#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def batch_counts(rows: pa.Table) -> pa.Table:
    """(lang, source, term, n, n_docs) of some rows of (lang, source, text): occurrences and documents of each term."""
    words = pc.split_pattern_regex(pc.ascii_lower(rows.column("text").combine_chunks()), BETWEEN)
    document = pc.list_parent_indices(words)
    said = pa.table({"document": document, "term": pc.list_flatten(words)})
    said = said.filter(pc.not_equal(said.column("term"), ""))
    by_document = said.group_by(["document", "term"], use_threads=False).aggregate([([], "count_all")])
    at = by_document.column("document")
    spread = pa.table({
        "lang": rows.column("lang").take(at), "source": rows.column("source").take(at), "term": by_document.column("term"), "n": by_document.column("count_all"),
    })
    return added_up(spread.append_column("n_docs", pa.repeat(pa.scalar(1, pa.int64()), len(at))))


def added_up(counts: pa.Table) -> pa.Table:
    out = counts.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n_docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "n_docs_sum"]).rename_columns(["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame, options: Cube) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of each term, added up within a task first."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.Table] = []

        def handed(limit: int) -> Iterator[dict]:
            """Add up what is held; hand it on if it stays over the limit."""
            total = added_up(pa.concat_tables(held))
            held[:] = [total] if len(total) <= limit else []
            if not held:
                for part in total.to_batches():
                    yield dict(zip(part.schema.names, part.columns, strict=True))
            pa.default_memory_pool().release_unused()

        for batch in batches:
            rows, at = pa.Table.from_batches([batch]), 0
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            while at < len(sizes):
                # As many rows as have the bytes that a task takes at a time, at least one.
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + options.batch_bytes, "right")))
                held.append(batch_counts(rows.slice(at, end - at)))
                if sum(map(len, held)) > options.held_terms:
                    yield from handed(options.held_terms // 2)
                at = end
        if held:
            yield from handed(-1)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = map_batches(rows, "lang string, source string, term string, n long, n_docs long", body)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(UNIT * (count + 1) / (total + terms)); counts too large for a long go through decimals."""
    wide = lambda c: c.cast("decimal(27,0)")
    divided = lambda up, down: F.call_function("div", up, down).cast("long")
    small = divided((count.cast("long") + 1) * F.lit(UNIT).cast("long"), total.cast("long") + terms)
    large = divided((wide(count) + 1).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)"), (wide(total) + wide(terms)).cast("decimal(28,0)"))
    return F.lit(1).cast("long") + F.when((count < 9_000_000_000) & (total < 1 << 62), small).otherwise(large)


@dataclass(frozen=True)
class Counted:
    """What the documents hold: kept counts (lang, source, term, n, p, q) and groups (lang, source, total, p0, terms, group_blocks, term_blocks)."""

    kept: DataFrame
    groups: DataFrame


def counted(docs: DataFrame, options: Cube) -> Counted:
    counts = cut(term_counts(docs, options))
    terms = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs")).filter(F.col("docs") >= options.least_documents).drop("docs"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    kept = cut(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = named.groupBy("lang").agg(F.count("*").alias("sources"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    groups = (
        named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1))
        .withColumn("group_blocks", blocks("sources", options.group_block)).withColumn("term_blocks", blocks("terms", options.term_block))
        .select("lang", "source", "total", "p0", "terms", "lang_total", "group_blocks", "term_blocks")
    )
    groups = cut(groups)
    rows = kept.join(groups.drop("p0"), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    return Counted(cut(rows.select("lang", "source", "term", "p", "q", "group_blocks", "term_blocks")), groups)


def partial(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of floor((p - q)^2 / q) along the last axis; squares stay below 2^63 as p and q are at most UNIT + 1."""
    d = p - q
    return (d * d // q).sum(axis=-1)


def cell(table: pa.Table) -> pa.Table:
    """Partial divergences of all ordered pairs of different sources of the cell's two group blocks.

    Rows without a term are the sources themselves. A term that no source of the cell has adds the same for every
    such term; the reducer adds it from the number of terms seen here.
    """
    block, source, term, p = (table.column(n).combine_chunks() for n in ("block", "source", "term", "p"))
    head = np.asarray(term.is_null())
    names = source.to_numpy(zero_copy_only=False)
    values, blocks = p.to_numpy(), block.to_numpy()
    groups = {s: i for i, s in enumerate(names[head])}
    base, of = values[head], blocks[head]
    coded = term.dictionary_encode()
    shares = np.repeat(base[:, None], len(coded.dictionary), axis=1)
    at = np.array([groups[s] for s in names[~head]], np.int64)
    shares[at, coded.indices.filter(pa.array(~head)).to_numpy()] = values[~head]
    b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
    out: dict[str, list] = {"source": [], "item": [], "p0": [], "q0": [], "value": []}
    order = list(groups)
    for ours, theirs in {(b1, b2), (b2, b1)}:
        left, right = np.flatnonzero(of == ours), np.flatnonzero(of == theirs)
        for i in left:
            others = right[right != i]
            out["source"] += [order[i]] * len(others)
            out["item"] += [order[j] for j in others]
            out["p0"] += [int(base[i])] * len(others)
            out["q0"] += base[others].tolist()
            out["value"] += partial(shares[i], shares[others]).tolist()
    n = len(out["source"])
    lang = table.column("lang")[0].as_py()
    return pa.table(
        {"lang": [lang] * n, **out, "seen": [len(coded.dictionary)] * n},
        schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p0", pa.int64()), ("q0", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())]),
    )


def source_pairs(found: Counted) -> DataFrame:
    """(lang, source, item, value): each source's divergence from each other source of its language."""
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = found.kept.select("lang", "source", "term", "p", "group_blocks", slot("source", "group_blocks").alias("block"), slot("term", "term_blocks").alias("t"))
    # The sources themselves go to the cells of every term block.
    heads = found.groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "group_blocks",
        slot("source", "group_blocks").alias("block"), upto("term_blocks").alias("t"),
    )
    slices = rows.unionByName(heads).withColumn("other", upto("group_blocks"))
    cells = slices.select("lang", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "t", "block", "source", "term", "p")
    parts = cells.groupBy("lang", "b1", "b2", "t").applyInArrow(cell, "lang string, source string, item string, p0 long, q0 long, value long, seen long")
    summed = parts.groupBy("lang", "source", "item", "p0", "q0").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    terms = found.groups.select("lang", "terms").distinct()
    d = F.col("p0") - F.col("q0")
    rest = (F.col("terms") - F.col("seen")) * F.call_function("div", d * d, F.col("q0"))
    return summed.join(terms, "lang").select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def source_terms(found: Counted) -> DataFrame:
    """(lang, source, item, value): the terms that a source has more of than its language, with their part of the divergence."""
    d = F.col("p") - F.col("q")
    return found.kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", d * d, F.col("q")).alias("value"))


def audit(docs: DataFrame, options: Cube = Cube()) -> DataFrame:
    """Ranked divergences (lang, source, part, item, value, rank) of the sources of each language.

    Part `pair` has every other source of the language, part `term` the source's own terms that it has more of than
    its language, up to the number of terms asked for. A null text, lang or source is an empty one; a repeated row is
    a document of its own. A source whose texts hold no kept term, or only blanks, still has its pairs. A language
    without kept terms has pairs of value 0 and no terms; one with a single source has no pairs. An empty table gives
    no rows. Other columns are not read.
    """
    found = counted(docs, options)

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(source_pairs(found), "pair").unionByName(ranked(source_terms(found), "term").filter(F.col("rank") <= options.terms))
