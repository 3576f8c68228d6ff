"""The derived tables once more, as SQL for the checking engine. Times are unix seconds."""

from __future__ import annotations

import re

from newsflow.catalog.views import BASE, STEP

_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z'']+'))"
STOP = (
    "'the','a','an','of','in','on','at','to','for','and','or','is','are','was','were','be','as','by','with','from',"
    "'that','this','it','its','their','his','her','he','she','they','you','i'"
)

VIEWS = {
    "articles": f"""
        SELECT doc_id AS article_id, doc_id AS seq, doc_id // 50 AS batch_id, source AS source_name, lang,
          CASE WHEN doc_id % 9 = 0 THEN text ELSE substring(text, 1, 80) END AS title, CASE WHEN doc_id % 9 = 0 THEN '' ELSE substring(text, 81) END AS description,
          'https://www.src' || (n % 20) || '.example.com/a/' || n ||
            CASE doc_id % 3 WHEN 1 THEN '?u=' || doc_id WHEN 2 THEN '#s' ELSE '' END AS url,
          {BASE} + doc_id * {STEP} AS published_s, (doc_id * 37) % 100 / 10.0::DOUBLE AS score, text
        FROM (SELECT *, CASE WHEN doc_id % 40 IN (23, 27, 31, 35) THEN doc_id - 20 ELSE doc_id END AS n FROM documents)""",
    "keyed": "SELECT *, sha256(regexp_replace(url, '[?#].*$', '')) AS url_hash FROM articles",
    "headlines": """
        SELECT article_id, lang,
          CASE WHEN article_id % 13 = 0 THEN '习惯高油价吧 - ' ELSE '' END || title || ' ' || description AS text FROM articles""",
    "letters": """
        SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents""",
    "held_out": """
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 3 = 1 AS held
        FROM documents""",
    "profile_counts": """
        SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram
          FROM letters JOIN held_out USING (doc_id) WHERE NOT held AND lang IS NOT NULL) GROUP BY 1, 2""",
    "profiles": """
        SELECT lang, gram, ln((coalesce(n, 0) + 1) / (total + v)) AS log_p
        FROM (SELECT * FROM (SELECT DISTINCT gram FROM profile_counts), (SELECT lang, sum(n) AS total FROM profile_counts GROUP BY 1),
          (SELECT count(DISTINCT gram) AS v FROM profile_counts))
        LEFT JOIN profile_counts USING (lang, gram)""",
    "head_letters": """
        SELECT article_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM headlines""",
    "detected": """
        SELECT article_id, arg_min(lang, (-score, lang)) AS detected FROM (SELECT article_id, lang, round(sum(n * log_p), 6) AS score FROM (
            SELECT article_id, gram, count(*) AS n FROM (
              SELECT article_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM head_letters) GROUP BY 1, 2)
          JOIN profiles USING (gram) GROUP BY 1, 2) GROUP BY 1""",
    "tokens": f"""
        SELECT article_id, batch_id, unnest({_TOKENS.format("title || ' ' || description")}) AS token FROM articles""",
    "batch_docs": "SELECT batch_id, count(*) AS n_docs FROM articles GROUP BY 1",
    "batch_df": "SELECT batch_id, token, count(*) AS df FROM tokens GROUP BY 1, 2",
    "vectors": f"""
        SELECT vec_id AS article_id, vec_id AS seq, vec_id // 250 AS batch_id, 'src' || (vec_id % 20) AS source_name, label,
          {BASE} + vec_id * {STEP} AS published_s, ({BASE} + vec_id * {STEP}) // 28800 * 28800 AS as_of_s,
          embedding::DOUBLE[] AS embedding, 'https://www.src' || (vec_id % 20) || '.example.com/v/' || vec_id AS url,
          'e' || label || '_' || (vec_id // 50) AS event_id FROM embeddings""",
    "points": """
        SELECT article_id AS point_id, event_id, embedding, max(published_s) OVER (PARTITION BY event_id) AS updated_s FROM vectors""",
    "recent": """
        SELECT a.article_id, b.article_id AS point_id, b.url, list_cosine_similarity(a.embedding, b.embedding) AS cosine
        FROM vectors a JOIN vectors b ON b.published_s >= a.as_of_s - 86400 AND b.published_s < a.as_of_s""",
    "near_points": """
        SELECT a.article_id, p.point_id, p.event_id, list_cosine_similarity(a.embedding, p.embedding) AS cosine,
          row_number() OVER (PARTITION BY a.article_id
            ORDER BY list_cosine_similarity(a.embedding, p.embedding) DESC, p.point_id) AS rank
        FROM vectors a JOIN points p ON p.updated_s >= a.as_of_s - 86400 AND p.updated_s < a.as_of_s""",
    "batch_pairs": """
        SELECT a.batch_id, a.seq AS earlier, b.seq AS later, list_cosine_similarity(a.embedding, b.embedding) AS cosine
        FROM vectors a JOIN vectors b ON a.batch_id = b.batch_id AND a.seq < b.seq""",
    "pool": f"""
        SELECT *, max(created_s) OVER (PARTITION BY cycle) AS as_of_s FROM (
          SELECT article_id, seq, article_id // 200 AS cycle, title, description, url, source_name, score, text,
            CASE WHEN article_id % 29 <> 0 THEN published_s END AS published_s, published_s + 600 AS created_s,
            CASE WHEN article_id % 4 = 1 THEN 0.0 WHEN article_id % 4 > 1 THEN (article_id % 7) * 0.5 END::DOUBLE AS heat_score,
            CASE WHEN article_id % 3 <> 0 THEN {BASE} + article_id * {STEP} - 3600 * (article_id % 5) END AS first_seen_s
          FROM articles)""",
    "eligible": """
        SELECT * REPLACE (coalesce(published_s, created_s) AS published_s, coalesce(nullif(heat_score, 0), 1.0) AS heat_score)
        FROM pool WHERE created_s > as_of_s - 43200 AND score >= 5.0""",
    "tiered": """
        SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY tier, score DESC, seq) AS batch_rank FROM (
          SELECT *, CASE WHEN as_of_s - published_s <= 14400 AND score >= 7 THEN 1
            WHEN as_of_s - published_s <= 14400 AND score >= floor_ THEN 2 WHEN score >= floor_ THEN 3
            WHEN weekday AND score >= 5 THEN 4 END AS tier
          FROM (SELECT *, CASE WHEN weekday THEN 6.0 ELSE 5.0 END AS floor_ FROM (
            SELECT *, isodow(make_timestamp(as_of_s * 1000000) - INTERVAL 5 HOUR) < 6 AS weekday FROM eligible)))
        WHERE tier IS NOT NULL""",
    "newest": """
        SELECT *, 5 AS tier, row_number() OVER (PARTITION BY cycle ORDER BY published_s DESC, score DESC, seq) AS batch_rank
        FROM eligible""",
    "batch": """
        SELECT cycle, article_id, tier, score, published_s, batch_rank FROM tiered
        WHERE batch_rank <= 10 AND cycle IN (SELECT cycle FROM tiered GROUP BY 1 HAVING count(*) >= 3)
        UNION ALL SELECT cycle, article_id, tier, score, published_s, batch_rank FROM newest
        WHERE batch_rank <= 3 AND cycle NOT IN (SELECT cycle FROM tiered GROUP BY 1 HAVING count(*) >= 3)""",
    "ranked": """
        SELECT cycle, article_id, score, published_s, batch_rank,
          CASE WHEN cycle % 3 <> 2 AND batch_rank % 4 <> 3 THEN (article_id * 7) % 11 / 2.0 ELSE 0.0 END AS priority_score,
          row_number() OVER (PARTITION BY cycle ORDER BY
            CASE WHEN cycle % 3 <> 2 THEN CASE WHEN batch_rank % 4 <> 3 THEN (article_id * 7) % 11 / 2.0 ELSE 0.0 END ELSE score END DESC,
            CASE WHEN cycle % 3 <> 2 THEN published_s END DESC, batch_rank) AS rank
        FROM batch""",
    "scores": """
        SELECT article_id, score, CASE article_id % 6 WHEN 0 THEN score WHEN 1 THEN score WHEN 5 THEN score
          WHEN 2 THEN CASE WHEN article_id % 12 = 2 THEN 6.0 END END AS llm_score,
          CASE article_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'text' WHEN 5 THEN '' WHEN 2 THEN 'again' END AS llm_comment
        FROM articles""",
    "sources": """
        SELECT source AS source_id, n AS source_order, CASE WHEN n % 5 = 3 THEN '' ELSE upper(source) END AS name,
          CASE WHEN n % 7 = 6 THEN '' ELSE 'https://feeds.' || source || '.example.com/rss' END AS feed_url,
          CASE WHEN n % 6 = 5 THEN '' ELSE source || '.example.com' END AS domain, n % 9 <> 4 AS in_use
        FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS BIGINT) AS n FROM documents)""",
    "names": """
        SELECT ['congress', 'cabinet', 'notable', 'alias'][item_id % 4 + 1] AS kind,
          string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS full_name,
          CASE WHEN item_id % 8 <> 2 THEN string_split(text, ' ')[2] END AS last_name, item_id % 5 = 0 AS ambiguous
        FROM benchmark""",
    "patterns": """
        SELECT DISTINCT pattern FROM (SELECT full_name AS pattern FROM names UNION ALL
          SELECT last_name FROM names WHERE kind <> 'alias' AND last_name IS NOT NULL AND NOT (kind = 'congress' AND ambiguous))
        WHERE pattern <> ''""",
    "words": """
        SELECT doc_id AS article_id, lang, list_transform(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'),
          lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}.]+$', '', 'g'),
            '(’s|''s)$', ''), '(\\p{Ll})\\.$', '\\1')) AS w FROM documents""",
    "hits": """
        SELECT article_id, pos, n_words, pattern FROM (
          SELECT article_id, pos, n_words, array_to_string(list_slice(w, pos + 1, pos + n_words), ' ') AS pattern
          FROM (SELECT article_id, w, unnest(range(len(w))) AS pos FROM words), (SELECT unnest([1, 2, 3, 4]) AS n_words)
          WHERE pos + n_words <= len(w)) SEMI JOIN patterns USING (pattern)""",
    "ents": f"""
        SELECT * FROM (SELECT article_id, batch_id, 'ev' || (article_id // 10) AS event_id, description,
          unnest({_TOKENS.format("title || chr(10) || description")}) AS token FROM articles)
        WHERE length(token) > 1 AND token NOT IN ({STOP})""",
    "event_tokens": """
        SELECT event_id, token, count(*) AS df, bool_or(article_id % 10 = 0) AS is_seed FROM ents GROUP BY 1, 2""",
    "hub": "SELECT token, event_id FROM event_tokens WHERE is_seed OR df >= 2",
    "hub_score": "SELECT token, count(DISTINCT event_id) AS score FROM hub GROUP BY 1",
    "event_texts": """
        SELECT 'ev' || (article_id // 10) AS event_id, arg_max(title || chr(10) || description, article_id) AS representative_text
        FROM articles GROUP BY 1""",
    "candidates": f"""
        SELECT a.batch_id, a.article_id AS cluster_id, e.event_id, r.rank, CAST(1.0 - r.rank * 0.125 AS DOUBLE) AS cosine,
          a.article_id % 11 = 5 AS unread, a.article_id % 22 <> 5 AS has_texts,
          {_TOKENS.format("CASE WHEN a.article_id % 33 = 27 THEN e.representative_text || chr(10) || a.title ELSE a.title || chr(10) || a.description END")} AS tokens_a,
          {_TOKENS.format("e.representative_text")} AS tokens_b
        FROM articles a, (SELECT unnest([1, 2]) AS rank) r, event_texts e WHERE e.event_id = 'ev' || (a.article_id // 10 - r.rank)""",
    "overlap": """
        SELECT cluster_id, event_id, coalesce(sum(w) FILTER (both_) / nullif(sum(w), 0), 0.0) AS overlap FROM (
          SELECT c.cluster_id, c.event_id, c.both_, ln((n.n_docs + 1) / (coalesce(f.df, 0) + 1)) AS w
          FROM (SELECT batch_id, cluster_id, event_id, t AS token, list_contains(tokens_a, t) AND list_contains(tokens_b, t) AS both_
                FROM (SELECT *, unnest(list_distinct(tokens_a || tokens_b)) AS t FROM candidates)) c
          JOIN batch_docs n USING (batch_id) LEFT JOIN batch_df f USING (batch_id, token))
        GROUP BY 1, 2""",
    "shared": """
        SELECT c.cluster_id, c.event_id, e.token, s.score FROM candidates c
        JOIN ents e ON e.article_id = c.cluster_id AND NOT c.unread
        JOIN hub h ON h.event_id = c.event_id AND h.token = e.token LEFT JOIN hub_score s ON s.token = e.token""",
    "hubs_only": "SELECT * FROM shared x WHERE NOT EXISTS (SELECT 1 FROM shared y WHERE y.cluster_id = x.cluster_id AND y.event_id = x.event_id AND y.score < 2)",
    "rule": """
        SELECT c.cluster_id, c.event_id, c.rank, c.cosine,
          CASE WHEN c.unread OR NOT EXISTS (SELECT 1 FROM ents e WHERE e.article_id = c.cluster_id)
               THEN CASE WHEN NOT c.has_texts THEN 'FAIL_OPEN' WHEN o.overlap >= 0.15 THEN 'COMPATIBLE' ELSE 'AMBIGUOUS' END
               WHEN NOT EXISTS (SELECT 1 FROM hub h WHERE h.event_id = c.event_id) THEN 'COMPATIBLE'
               WHEN s.n IS NULL THEN 'NO_OVERLAP' WHEN s.rare THEN 'COMPATIBLE' WHEN p.n IS NOT NULL THEN 'COMPATIBLE'
               ELSE 'AMBIGUOUS' END AS rule_verdict
        FROM candidates c LEFT JOIN overlap o USING (cluster_id, event_id)
        LEFT JOIN (SELECT cluster_id, event_id, count(*) AS n, bool_or(score < 2) AS rare FROM shared GROUP BY 1, 2) s
          USING (cluster_id, event_id)
        LEFT JOIN (SELECT x.cluster_id, x.event_id, count(*) AS n FROM hubs_only x
            JOIN hubs_only y ON x.cluster_id = y.cluster_id AND x.event_id = y.event_id AND x.token < y.token
            JOIN pair_score k ON k.token_a = x.token AND k.token_b = y.token WHERE k.score <= 1 GROUP BY 1, 2) p
          USING (cluster_id, event_id)""",
    "pair_score": """
        SELECT p.token_a, p.token_b, count(*) AS score
        FROM (SELECT DISTINCT x.token AS token_a, y.token AS token_b FROM hubs_only x JOIN hubs_only y
              ON x.cluster_id = y.cluster_id AND x.event_id = y.event_id AND x.token < y.token) p
        JOIN hub a ON a.token = p.token_a JOIN hub b ON b.token = p.token_b AND b.event_id = a.event_id GROUP BY 1, 2""",
    "judged": """
        SELECT r.*, CASE rule_verdict WHEN 'NO_OVERLAP' THEN false WHEN 'AMBIGUOUS' THEN coalesce(l.quality = 1, false)
          ELSE true END AS accepted, CAST(CASE l.toxic WHEN 1 THEN 1.5 WHEN 0 THEN 0.2 ELSE 1.0 END AS DOUBLE) AS weight
        FROM rule r LEFT JOIN labels l ON l.doc_id = r.cluster_id AND r.event_id = 'ev' || (l.doc_id // 10 - 1)""",
    "walk": """
        SELECT cluster_id, arg_min(event_id, rank) FILTER (accepted) AS matched_event_id,
          arg_min(cosine, rank) FILTER (accepted) AS matched_cosine,
          coalesce(arg_min(weight, rank) FILTER (accepted), CAST(1.0 AS DOUBLE)) AS multiplier,
          count(*) FILTER (NOT accepted AND rule_verdict = 'AMBIGUOUS') AS n_links
        FROM judged GROUP BY 1""",
    "cluster_in": """
        SELECT batch_id, CAST(label AS BIGINT) AS cluster_seq, seq, source_name, published_s, embedding, url,
          CASE WHEN seq % 3 = 2 THEN 'duplicate' ELSE 'member' END AS role FROM vectors""",
}


def with_views(sql: str) -> str:
    """Put the views a statement uses, and those they use, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    recursive = re.match(r"\s*WITH RECURSIVE\s+", sql)
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if recursive:
        return f"WITH RECURSIVE {parts}, {sql[recursive.end():]}"
    return f"WITH {parts} {sql}"
