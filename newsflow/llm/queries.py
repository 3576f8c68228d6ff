"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import (
    chat, decontaminate, divergence, language_id, near_dup, one_bit_search, packing, prefix_trie, quality, secrets, sharding, suffix_dedup,
    toxicity,
)
from newsflow.llm.common import table
from newsflow.session import prepare

#: Limits of the registered queries.
SHARD_BYTES = 8 << 20
#: A limit at which small tables split as well.
SMALL_SHARD_BYTES = 64 << 10
OP5 = near_dup.NearDuplicates(words=3, percent=85)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(table(prepare(spark), folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(prepare(spark), folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(prepare(spark), folder, "documents"), table(spark, folder, "benchmark"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages(table(prepare(spark), folder, "documents"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(prepare(spark), folder, "documents"), OP5)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(prepare(spark), folder, "documents"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    told = table(prepare(spark), folder, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(told.unionByName(extra))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(prepare(spark), folder, "documents"), table(spark, folder, "labels"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(prepare(spark), folder, "documents"), table(spark, folder, "labels"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.directory(table(prepare(spark), folder, "documents"), SHARD_BYTES)


def sharding_small(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.directory(table(prepare(spark), folder, "documents"), SMALL_SHARD_BYTES)


def op11_one_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit_search.nearest(table(prepare(spark), folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(prepare(spark), folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(prepare(spark), folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_best_fit_packing, op3_decontamination, op4_language_id, op5_near_duplicates, op6_suffix_dedup,
        op7_chat_format, op8_quality_rules, op9_toxicity, op10_sharding, sharding_small, op11_one_bit_search, op12_source_divergence, op13_prefix_trie,
    )
}

def _sharding_sql(limit: int) -> str:
    return f"""
        WITH hashed AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents
        ), bits AS (
            SELECT doc_id, n_bytes, (CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS BIT)::VARCHAR)[33:] AS bits FROM hashed
        ), levels AS (
            SELECT doc_id, n_bytes, d AS depth, substr(bits, 1, CAST(d AS INT)) AS shard,
                sum(n_bytes) OVER (PARTITION BY d, substr(bits, 1, CAST(d AS INT))) AS shard_bytes,
                count(*) OVER (PARTITION BY d, substr(bits, 1, CAST(d AS INT))) AS shard_rows
            FROM bits, range(0, 33) AS r(d)
        ), first AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM levels
            WHERE shard_bytes <= {limit} OR shard_rows = 1
        )
        SELECT doc_id, n_bytes, shard, CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {limit} AS oversized
        FROM first WHERE n = 1
    """


SQL: dict[str, str] = {
    "op7_chat_format": r"""
        WITH told AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', '', '' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', '', ''
        ), marked AS (
            SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(role, '\', '\\'), '<|', '<\|') AS er FROM told
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(er) + length(et) + 23) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op10_sharding": _sharding_sql(SHARD_BYTES),
    "sharding_small": _sharding_sql(SMALL_SHARD_BYTES),
    # Every pair of a query and a candidate; the operator reranks so widely that it finds the same.
    "op11_one_bit_search": r"""
        WITH rows AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY vec_id
        ), pairs AS (
            SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))) AS score
            FROM rows q JOIN rows p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs
        ) WHERE rank <= 5
    """,
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), said AS (
            SELECT lang, source, term, n, count(*) AS c FROM (SELECT lang, source, n, unnest(words) AS term FROM docs) GROUP BY ALL
        ), kept AS (
            SELECT lang, term, sum(c)::HUGEINT AS lang_n FROM said GROUP BY lang, term HAVING count(*) >= 3
        ), langs AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), counts AS (
            SELECT lang, source, term, sum(c)::HUGEINT AS c FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), totals AS (
            SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
        ), shares AS (
            SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (total + v) AS p,
                1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v) AS q
            FROM totals JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        ), pair_values AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), both_parts AS (
            SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN pair_values USING (lang, source, item)
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_prefix_trie": r"""
        WITH told AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), lists AS (
            SELECT conv_id, list(said ORDER BY pos) AS turns, conv_id - conv_id % 100 AS base,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
            FROM told GROUP BY conv_id
        ), rebuilt AS (
            SELECT l.conv_id, list_concat(coalesce(b.turns[1:l.h], []), l.turns[l.h + 1:]) AS turns FROM lists l LEFT JOIN lists b ON b.conv_id = l.base
        ), prefixes AS (
            SELECT conv_id, d AS depth, turns[1:d] AS node, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].text) END AS chars, d = len(turns) AS final
            FROM rebuilt, unnest(range(0, len(turns) + 1)) AS t(d)
        ), nodes AS (
            SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256
            FROM prefixes GROUP BY depth, node
        ), children AS (
            SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), known AS (
            SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.node = c.node
        ), sums AS (
            SELECT d AS depth, node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
            FROM known, unnest(range(0, depth + 1)) AS t(d) GROUP BY ALL
        )
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
        FROM known k JOIN sums s ON k.depth = s.depth AND k.node = s.node LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.node = k.node[1:k.depth - 1]
    """,
}
