"""The registered queries: each operator over the derived tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.catalog.sql_views import with_views
from newsflow.catalog.views import LEXICON, MAJOR, SAID, Views
from newsflow.functions import language as lang_fn
from newsflow.functions import text as text_fn
from newsflow.functions.urls import host, host_suffixes, normalized_url, url_hash
from newsflow.functions.vectors import cosine
from newsflow.operators import clustering, dedup, entities, evidence, heat, pages, scanjoin, select, simjoin, state
from newsflow.params import Params
from newsflow.plans import ingest
from newsflow.session import cut, fresh_path
from newsflow.sources import feeds, tables

# The derived vectors are less alike than real articles: lower floors and shorter windows.
P = replace(
    Params(), related_floor=0.35, duplicate_floor=0.40, posted_floor=0.40, history_hours=24, event_hours=24,
    posted_hours=24, major_outlets=MAJOR,
)
TOP_FLOOR = 0.25
#: Ids that one feed file spans.
FEED_SPAN = 4000
WEIGHTS = {"CORE_UPDATE": 1.5, "CORROBORATION": 1.0, "RESTATEMENT": 0.2}

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(body: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = body
        if sql:
            SQL[name] = with_views(sql)
        return body

    return register


def seconds(column) -> "F.Column":
    return F.unix_seconds(column)


def long(column) -> "F.Column":
    return F.col(column).cast("bigint") if isinstance(column, str) else column.cast("bigint")


def joined(column) -> "F.Column":
    return F.array_join(F.array_sort(column), " ")


# --- sources and sinks --------------------------------------------------------------------------

@query("source_registry", """
    SELECT source_id, coalesce(nullif(name, ''), feed_url) AS name, feed_url, domain FROM sources
    WHERE in_use AND feed_url <> ''""")
def _(v):
    return feeds.source_registry(v.sources).select("source_id", "name", "feed_url", "domain")


@query("feed_scan", r"""
    SELECT k.article_id, k.url, k.url_hash, coalesce(nullif(s.name, ''), s.feed_url) AS source_name,
      regexp_replace(k.title, '^\s+|\s+$', '', 'g') AS title, regexp_replace(k.description, '^\s+|\s+$', '', 'g') AS description,
      CASE WHEN article_id % 5 = 4 AND article_id % 2 = 1 THEN (SELECT max(published_s) FROM articles) ELSE published_s END AS published_s
    FROM keyed k JOIN sources s ON s.source_id = k.source_name
    WHERE s.in_use AND s.feed_url <> '' AND article_id % 17 <> 5""")
def _(v):
    rows = feeds.feed_scan(feeds.parse_items(v.items), feeds.source_registry(v.sources), v.latest)
    return rows.select(
        "article_id", "url", "url_hash", "source_name", "title", "description", seconds("published_at").alias("published_s")
    )


@query("feed_files", r"""
    SELECT k.url, k.url_hash, coalesce(nullif(s.name, ''), s.feed_url) AS source_name, count(*) AS n
    FROM keyed k JOIN sources s ON s.source_id = k.source_name
    WHERE s.in_use AND s.feed_url <> '' AND article_id % 17 <> 5 GROUP BY ALL
    UNION ALL SELECT '', '', s.source_id, 1 FROM sources s""")
def _(v):
    """The same feeds as landed files, one folder per source, with an unreadable file in each."""
    path = fresh_path(v.spark, "feeds")
    # A document has a bounded range of ids of one source: files of some hundred kilobytes, as the price of a file is that of its opening.
    entry = F.startswith("xml", F.lit("<entry"))
    documents = v.items.groupBy("source_id", F.expr(f"article_id DIV {FEED_SPAN}").alias("span"), entry.alias("entry")).agg(F.collect_list("xml").alias("parts"))
    root = lambda name: F.concat(F.lit(f"<{name}>"), F.array_join("parts", ""), F.lit(f"</{name}>"))
    files = documents.select("source_id", F.when(F.col("entry"), root("feed")).otherwise(root("rss")).alias("xml"))
    # A file that breaks off inside an item.
    broken = v.sources.select("source_id", F.lit("<rss><channel><item><title>half").alias("xml"))
    files.unionByName(broken).write.option("maxRecordsPerFile", 1).partitionBy("source_id").text(path)
    # Parsed once, for the articles and for the unreadable files.
    items = cut(feeds.read_feed_files(v.spark, path))
    rows = feeds.feed_scan(items, feeds.source_registry(v.sources), v.latest)
    read = rows.groupBy("url", "url_hash", "source_name").agg(F.count("*").alias("n"))
    unread = feeds.malformed(items).groupBy("source_id").agg(F.count("*").alias("n"))
    return read.unionByName(unread.select(F.lit("").alias("url"), F.lit("").alias("url_hash"), F.col("source_id").alias("source_name"), "n"))


@query("fresh_articles", """
    SELECT article_id, source_name, published_s FROM articles
    WHERE published_s >= (SELECT max(published_s) FROM articles) - 10800""")
def _(v):
    rows = select.fresh_articles([v.articles], v.latest, P.max_publish_age_hours)
    return rows.select("article_id", "source_name", seconds("published_at").alias("published_s"))


@query("gazetteer_patterns", "SELECT pattern, 'PERSON' AS label FROM patterns")
def _(v):
    return v.patterns


@query("trending_topn", """
    SELECT batch_id, rank, title FROM (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS rank,
      CASE WHEN article_id % 4 = 2 THEN '' ELSE title END AS title FROM articles) WHERE rank <= 15 AND title <> ''""")
def _(v):
    title = F.when(F.col("article_id") % 4 == 2, "").otherwise(F.col("title"))
    entries = v.articles.select("batch_id", F.col("seq").alias("position"), title.alias("title"))
    return select.trending_topn(entries, P.trending_limit, ["batch_id"]).select("batch_id", long("rank").alias("rank"), "title")


@query("pool_write", """
    SELECT article_id, title, k.url, url_hash, text AS description, published_s, k.score,
      coalesce(CASE WHEN article_id % 3 <> 0 THEN published_s - 60 END, published_s) AS first_seen_s FROM keyed k""")
def _(v):
    first_seen = F.when(F.col("article_id") % 3 != 0, F.col("published_at") - F.expr("INTERVAL 60 SECOND"))
    rows = v.articles.withColumns({
        "description": F.col("text"), "url_hash": url_hash(F.col("url")), "score_comment": F.lit(""),
        "heat_score": F.lit(1.0), "event_first_seen_at": first_seen,
    })
    return select.pool_row(rows, P.stored_chars).select(
        "article_id", "title", "url", "url_hash", "description", seconds("published_at").alias("published_s"), "score",
        seconds("event_first_seen_at").alias("first_seen_s"),
    )


@query("pool_eligible", """
    SELECT cycle, article_id, score, published_s, heat_score FROM eligible""")
def _(v):
    rows = select.pool_eligible(v.pool, "as_of", P.pool_hours, P.pool_score_floor)
    return rows.select("cycle", "article_id", "score", seconds("published_at").alias("published_s"), "heat_score")


@query("pool_unsent", """
    SELECT article_id, cycle, score FROM pool WHERE article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(v):
    return select.pool_unsent(v.pool, v.send_log).select("article_id", "cycle", "score")


DECISION = (
    "cluster_id bigint, event_id string, cosine double, rule_verdict string, final_verdict string, accepted boolean, candidate_url string, "
    "candidate_text string, matched_text string, same_raw string, subtype_raw string, multiplier double, logged_at timestamp"
)


@query("decision_log", """
    SELECT j.cluster_id, j.event_id, j.cosine, rule_verdict,
      CASE WHEN rule_verdict = 'NO_OVERLAP' THEN 'UNRELATED' WHEN accepted THEN 'SAME_OCCURRENCE' ELSE 'RELATED_DIFFERENT_EVENT' END AS final_verdict,
      accepted, a.url AS candidate_url, a.title || chr(10) || a.description AS candidate_text, e.representative_text AS matched_text,
      CASE l.quality WHEN 1 THEN 'VERDICT: SAME_EVENT' || chr(10) || 'REASON: x' WHEN 0 THEN 'reason: y' || chr(10) || 'verdict (final): different_event' END AS same_raw,
      CASE l.toxic WHEN 1 THEN 'SUBTYPE: CORE_UPDATE' WHEN 0 THEN 'Subtype: restatement' END AS subtype_raw,
      CASE WHEN accepted THEN weight ELSE CAST(1.0 AS DOUBLE) END AS multiplier, (SELECT max(published_s) FROM articles) AS logged_s
    FROM judged j JOIN articles a ON a.article_id = j.cluster_id JOIN event_texts e ON e.event_id = j.event_id
    LEFT JOIN labels l ON l.doc_id = j.cluster_id AND j.event_id = 'ev' || (l.doc_id // 10 - 1)""")
def _(v):
    """All decisions with the texts and answers they rest on, appended as JSON lines in two cycles and read back."""
    path = fresh_path(v.spark, "decisions")
    texts = v.articles.select(
        F.col("article_id").alias("cluster_id"), F.col("url").alias("candidate_url"),
        text_fn.compare_text(F.col("title"), F.col("description")).alias("candidate_text"),
    )
    # Decisions are kept without the texts, which meet those of one cycle on their way to the log.
    decided = cut(_judged(v).join(v.verdicts, ["cluster_id", "event_id"], "left").withColumn("logged_at", v.latest).select(
        "rank", *[c.split()[0] for c in DECISION.split(", ") if "_text " not in c and "_url " not in c]
    ))
    for rank in (1, 2):
        rows = decided.filter(F.col("rank") == rank).join(texts, "cluster_id").join(
            v.event_texts.withColumnRenamed("representative_text", "matched_text"), "event_id")
        tables.write_json_lines(rows.select(*[c.split()[0] for c in DECISION.split(", ")]), path)
    back = v.spark.read.schema(DECISION).json(path)
    return back.withColumn("logged_s", seconds(F.col("logged_at"))).drop("logged_at")


@query("post_export", r"""
    SELECT article_id, '_t acl cdate ' || CASE WHEN description <> '' THEN 'dsc ' ELSE '' END || 'prevsrc ' ||
      CASE WHEN title <> '' THEN 'ttl ' ELSE '' END || 'txt udate uid' AS fields,
      text || chr(10) || chr(10) || url AS txt, nullif(description, '') AS dsc FROM articles""")
def _(v):
    rows = select.export_record(v.articles.select(
        "article_id", text_fn.post_text(F.col("text"), F.col("url")).alias("post_text"),
        F.col("published_at").alias("as_of"), F.lit("u1").alias("user_id"), F.col("description").alias("preview_description"),
        F.lit("").alias("preview_image"), F.col("url").alias("preview_url"), F.col("title").alias("preview_title"),
    ))
    # One pass over the record gives its fields.
    data = F.from_json(F.col("record"), "data map<string,string>")["data"]
    return rows.select("article_id", data.alias("data")).select(
        "article_id", joined(F.map_keys("data")).alias("fields"), F.col("data")["txt"].alias("txt"), F.col("data")["dsc"].alias("dsc"),
    )


@query("history_retention", """
    SELECT article_id, published_s FROM vectors WHERE published_s >= (SELECT max(published_s) FROM vectors) - 86400""")
def _(v):
    """A history of four cycles below a folder, from which the retention job deletes what is too old."""
    store = tables.Tables(v.spark, fresh_path(v.spark, "history"))
    last = v.vectors.agg(F.max("batch_id").alias("m")).scalar()
    rows = v.vectors.select(
        "article_id", "url", url_hash(F.col("url")).alias("url_hash"), F.lit("").alias("content"), "published_at", "embedding",
        F.floor(F.col("batch_id") * 4 / (last + 1)).alias("landing"),
    )
    for cycle in range(4):
        store.commit(cycle, {"article_vectors": rows.filter(F.col("landing") == cycle).drop("landing")})
    store.expire("article_vectors", v.vectors.agg(F.max("published_at") - F.expr("INTERVAL 1 DAY")).first()[0])
    store.vacuum()
    return store.read("article_vectors").select("article_id", seconds("published_at").alias("published_s"))


# --- expressions --------------------------------------------------------------------------------

@query("url_hash", """
    SELECT 'a' || article_id AS row_id, regexp_replace(url, '[?#].*$', '') AS clean_url, url_hash FROM keyed
    UNION ALL SELECT 'p' || page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', ''),
      sha256(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '')) FROM pages""")
def _(v):
    urls = v.articles.select(F.concat(F.lit("a"), "article_id").alias("row_id"), "url").unionByName(
        v.table("pages").select(F.concat(F.lit("p"), "page_id").alias("row_id"), "url")
    )
    return urls.select("row_id", normalized_url(F.col("url")).alias("clean_url"), url_hash(F.col("url")).alias("url_hash"))


@query("published_utc", """
    SELECT article_id, CASE WHEN article_id % 5 = 4 AND article_id % 2 = 1
      THEN (SELECT max(published_s) FROM articles) ELSE published_s END AS published_s FROM articles""")
def _(v):
    rows = feeds.parse_items(v.items)
    at = text_fn.published_utc(F.col("pubDate"), F.col("updated"), v.latest)
    return rows.select("article_id", seconds(at).alias("published_s"))


@query("token_sets", """
    SELECT doc_id AS article_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (
      SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) AS t FROM documents)""")
def _(v):
    rows = v.texts.select("article_id", text_fn.word_tokens(F.col("text")).alias("t"))
    return rows.select("article_id", long(F.size("t")).alias("n_tokens"), joined("t").alias("tokens"))


@query("cjk_ratio", r"""
    SELECT article_id, round(coalesce(len(regexp_extract_all(text, '[一-鿿㐀-䶿豈-﫿぀-ヿ가-힣]')) /
      nullif(len(regexp_extract_all(text, '\p{L}')), 0)::DOUBLE, 0), 9) AS ratio FROM headlines""")
def _(v):
    return v.headlines.select("article_id", F.round(lang_fn.cjk_ratio(F.col("text")), 9).alias("ratio"))


@query("post_text_strip", """
    SELECT article_id, CASE WHEN article_id % 7 = 0 THEN title || ' ' || url ELSE title END AS stripped FROM articles""")
def _(v):
    url = F.col("url")
    post = F.when(F.col("article_id") % 7 == 0, F.concat("title", F.lit(" "), url)).otherwise(
        text_fn.post_text(F.col("title"), url)
    )
    return v.articles.select("article_id", text_fn.post_text_without_url(post, url).alias("stripped"))


@query("declined_filter", """
    SELECT article_id, text AS generated FROM articles WHERE article_id % 5 > 1""")
def _(v):
    return v.generated.filter(~text_fn.is_declined(F.col("generated"))).select("article_id", "generated")


@query("score_parse", "SELECT article_id, llm_score, llm_comment FROM scores WHERE llm_score IS NOT NULL")
def _(v):
    answer = F.coalesce(text_fn.json_score(F.col("score_raw")), text_fn.json_score(F.col("score_retry_raw")))
    return v.scores.select("article_id", answer.alias("a")).filter("a IS NOT NULL").select("article_id", "a.llm_score", "a.llm_comment")


def _rank_raw(v: Views) -> DataFrame:
    """One model answer per cycle over its batch: fenced with smart quotes, retried, or unreadable."""
    entry = F.concat(
        F.lit('{"id": "'), F.col("article_id").cast("string"), F.lit('", "priority_score": '),
        ((F.col("article_id") * 7) % 11 / 2.0).cast("string"), F.lit("}"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.collect_list(F.when(F.col("batch_rank") % 4 != 3, entry)), ", "), F.lit("]"))
    per = _batch(v).groupBy("cycle").agg(listed.alias("good"))
    fenced = F.concat(F.lit("```json\n"), F.replace("good", F.lit('"'), F.lit("”")), F.lit("\n```"))
    broken = F.replace("good", F.lit('"priority_score"'), F.lit('"score"'))
    c = F.col("cycle") % 3
    return per.select(
        "cycle", F.when(c == 0, fenced).when(c == 1, "Sorry").otherwise(broken).alias("rank_raw"),
        F.when(c == 1, F.col("good")).otherwise("[1, 2]").alias("rank_retry_raw"),
    )


@query("rank_parse", """
    SELECT cycle, article_id AS story_id, (article_id * 7) % 11 / 2.0 AS priority_score FROM batch
    WHERE cycle % 3 <> 2 AND batch_rank % 4 <> 3""")
def _(v):
    return select.parsed_ranks(_rank_raw(v), ["cycle"]).select("cycle", long("story_id").alias("story_id"), "priority_score")


@query("verdict_parse", """
    SELECT doc_id AS cluster_id, quality = 1 AS is_same, CASE WHEN toxic = 1 THEN 'CORE_UPDATE' ELSE 'RESTATEMENT' END AS subtype
    FROM labels""")
def _(v):
    return v.verdicts.select(
        "cluster_id", text_fn.says_same(F.col("same_raw")).alias("is_same"),
        text_fn.labelled_field(F.col("subtype_raw"), "SUBTYPE").alias("subtype"),
    )


@query("story_ages", """
    SELECT article_id, round_even((as_of_s - coalesce(first_seen_s, published_s)) / 3600.0::DOUBLE, 1)::DOUBLE AS hours_old,
      round_even((as_of_s - published_s) / 3600.0::DOUBLE, 1)::DOUBLE AS hours_since_update FROM pool""")
def _(v):
    now, first, published = F.col("as_of"), F.col("event_first_seen_at"), F.col("published_at")
    return v.pool.select(
        "article_id", text_fn.age_hours(now, F.coalesce(first, published)).alias("hours_old"),
        text_fn.age_hours(now, published).alias("hours_since_update"),
    )


@query("cosine_pairs", """
    SELECT a.article_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine
    FROM vectors a JOIN vectors b ON b.article_id = a.article_id + 1""")
def _(v):
    following = v.vectors.select((F.col("article_id") - 1).alias("article_id"), F.col("embedding").alias("other"))
    return v.vectors.join(following, "article_id").select(
        "article_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


@query("token_idf", """
    SELECT batch_id, token, df, round(ln((n_docs + 1) / (df + 1)), 9) AS idf FROM batch_df JOIN batch_docs USING (batch_id)""")
def _(v):
    return evidence.token_idf(v.tokens).withColumn("idf", F.round("idf", 9))


@query("doc_freq", "SELECT batch_id, token, df FROM batch_df")
def _(v):
    return evidence.doc_freq(v.tokens)


# --- filters ------------------------------------------------------------------------------------

@query("english_filter", r"""
    SELECT article_id FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM headlines) LEFT JOIN detected USING (article_id)
    WHERE coalesce(len(regexp_extract_all(t, '[一-鿿㐀-䶿豈-﫿぀-ヿ가-힣]')) / nullif(len(regexp_extract_all(t, '\p{L}')), 0)::DOUBLE, 0) <= 0.05
      AND (length(t) < 20 OR coalesce(detected, 'en') = 'en')""")
def _(v):
    # What the text decides is decided before the join, which then carries no texts.
    by_text = lang_fn.english_by_text(F.col("text"), P.cjk_max, P.min_language_chars)
    rows = v.headlines.select("article_id", by_text.alias("by_text")).join(
        v.detected(v.headlines.select("article_id", "text")), "article_id", "left")
    return rows.filter(lang_fn.english_of(F.col("by_text"), F.col("detected"))).select("article_id")


@query("language_profile", """
    SELECT article_id, lang, detected FROM headlines JOIN held_out ON doc_id = article_id AND held LEFT JOIN detected USING (article_id)""")
def _(v):
    """What is detected for texts that the profiles have not seen."""
    held = v.headlines.filter(F.crc32(F.col("article_id").cast("string")) % 3 == 1)
    return held.select("article_id", "lang").join(v.detected(held.select("article_id", "text")), "article_id", "left")


PHRASES_SQL = """
    WITH RECURSIVE phrases AS (
      SELECT lower(string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4]) AS phrase FROM benchmark
      UNION SELECT lower(trim(p)) FROM (SELECT unnest(string_split(text, '.')) AS p FROM benchmark) WHERE length(trim(p)) >= 20)
    SELECT article_id FROM articles WHERE NOT EXISTS (
      SELECT 1 FROM phrases WHERE phrase <> '' AND contains(lower(title || ' ' || description || ' ' || text), phrase))"""


def _phrases(v: Views) -> DataFrame:
    """A pair of words and the sentences of each passage: phrases of two words to some hundred letters."""
    w = F.split("text", " ")
    pairs = v.table("benchmark").select(F.concat(w[2], F.lit(" "), w[3]).alias("phrase"))
    sentences = v.table("benchmark").select(F.explode(F.split("text", r"\.")).alias("p")).select(F.trim("p").alias("phrase"))
    return pairs.unionByName(sentences.filter(F.length("phrase") >= 20))


@query("phrase_blocklist", PHRASES_SQL)
def _(v):
    return select.without_phrases(v.spread_articles, ["title", "description", "text"], _phrases(v)).select("article_id")


@query("score_gate", "SELECT article_id, llm_score AS score FROM scores WHERE llm_score >= 5.0")
def _(v):
    answer = F.coalesce(text_fn.json_score(F.col("score_raw")), text_fn.json_score(F.col("score_retry_raw")))
    rows = v.scores.select("article_id", answer["llm_score"].alias("score"))
    return rows.filter(F.col("score") >= P.score_floor)


@query("usable_text", """
    SELECT article_id, CASE WHEN length(t) >= 200 AND NOT contains(lower(t), 'try unlimited access') THEN t ELSE title END AS content
    FROM (SELECT article_id, title, CASE WHEN article_id % 8 = 0 THEN text || ' Try Unlimited Access.' ELSE text END AS t FROM articles)""")
def _(v):
    notice = F.when(F.col("article_id") % 8 == 0, F.lit(" Try Unlimited Access.")).otherwise("")
    text = F.concat("text", notice)
    content = text_fn.usable_text(text, F.col("title"), P.min_text_chars, P.paywall_phrases)
    return v.articles.select("article_id", content.alias("content"))


@query("published_guard", """
    SELECT n.article_id AS cluster_id, n.event_id FROM (
        SELECT * FROM near_points WHERE rank = 1 AND cosine >= 0.25) n
    WHERE NOT (n.cosine >= 0.35 AND n.event_id IN (SELECT event_id FROM vectors WHERE source_name IN ('src0', 'src5', 'src10')))""")
def _(v):
    published = v.vectors.groupBy("event_id").agg(F.bool_or(F.col("source_name").isin(*MAJOR)).alias("published"))
    matches = _top1(v).select(
        F.col("article_id").alias("cluster_id"), F.col("event_id").alias("matched_event_id"), F.col("cosine").alias("matched_cosine")
    )
    rows = select.published_guard(matches, published, P.related_floor)
    return rows.select("cluster_id", F.col("matched_event_id").alias("event_id"))


# --- joins --------------------------------------------------------------------------------------

def _claims(v: Views) -> DataFrame:
    days = F.when(F.col("quality") == 1, F.expr("INTERVAL 9 DAY")).otherwise(F.expr("INTERVAL 11 DAY"))
    flagged = v.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("article_id"), "quality")
    return v.articles.join(flagged, "article_id").select(
        url_hash(F.col("url")).alias("url_hash"), (v.latest - days).alias("claimed_at")
    )


@query("url_dedup", """
    SELECT article_id, url_hash FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY seq) AS n FROM keyed)
    WHERE n = 1 AND url_hash NOT IN (SELECT url_hash FROM keyed JOIN labels ON doc_id = article_id WHERE toxic = 1 AND quality = 1)""")
def _(v):
    keyed = v.articles.select("article_id", "seq", url_hash(F.col("url")).alias("url_hash"))
    return dedup.url_dedup(keyed, _claims(v), v.latest, P.url_ttl_seconds).select("article_id", "url_hash")


CLAIMS_SQL = """
    WITH RECURSIVE chain AS (
      SELECT user_id, min(epoch_us(ts)) AS t FROM events GROUP BY 1
      UNION ALL SELECT c.user_id, min(epoch_us(e.ts)) FROM chain c JOIN events e
        ON e.user_id = c.user_id AND epoch_us(e.ts) >= c.t + 86400000000 GROUP BY c.user_id, c.t)
    SELECT user_id, t AS claimed_us FROM chain"""


@query("url_claim_replay", CLAIMS_SQL)
def _(v):
    claims = dedup.claim_times(v.table("events"), "user_id", "ts", 86_400)
    return claims.select("user_id", F.unix_micros("claimed_at").alias("claimed_us"))


@query("url_claim_replay_hot", CLAIMS_SQL)
def _(v):
    """Every key with more than 40 times as a hot one, over slices of time."""
    claims = dedup.claim_times(v.table("events"), "user_id", "ts", 86_400, hot_times=40)
    return claims.select("user_id", F.unix_micros("claimed_at").alias("claimed_us"))


@query("cross_cycle_dedup", """
    SELECT a.article_id, round(coalesce(max(r.cosine), 0), 6) AS history_cosine, coalesce(max(r.cosine), 0) < 0.40 AS is_new
    FROM vectors a LEFT JOIN recent r USING (article_id) GROUP BY 1""")
def _(v):
    rows = dedup.cross_cycle_dedup(v.vectors, v.history, P.duplicate_floor, "as_of", P.history_hours)
    return rows.select("article_id", F.round("history_cosine", 6).alias("history_cosine"), "is_new")


@query("event_topk", """
    SELECT article_id, event_id, cosine, rank FROM (
      SELECT article_id, event_id, round(max(cosine), 6) AS cosine, row_number() OVER (PARTITION BY article_id ORDER BY min(rank)) AS rank
      FROM near_points WHERE rank <= 20 AND cosine >= 0.25 GROUP BY 1, 2) WHERE rank <= 5""")
def _(v):
    near = simjoin.nearest_points(
        v.vectors, v.points, P.event_candidates * P.points_per_candidate, TOP_FLOOR, "last_updated_at", "as_of", P.event_hours
    )
    top = evidence.event_topk(near, v.points, P.event_candidates)
    return top.select(F.col("query_id").alias("article_id"), "event_id", F.round("cosine", 6).alias("cosine"), long("rank").alias("rank"))


@query("event_topk_cells", """
    SELECT article_id, point_id, round(cosine, 6) AS cosine, rank FROM (
      SELECT a.article_id, b.article_id AS point_id, list_cosine_similarity(a.embedding, b.embedding) AS cosine,
        row_number() OVER (PARTITION BY a.article_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.article_id) AS rank
      FROM vectors a JOIN vectors b ON a.article_id % 10 = 0) WHERE rank <= 4 AND cosine >= 0.25""")
def _(v):
    """Every tenth vector of a collection stored in cells against all of it."""
    path = fresh_path(v.spark, "cells")
    rows = v.vectors.select(F.col("article_id").alias("id"), F.col("embedding").alias("vec"))
    scanjoin.write_cells(rows, path)
    near = scanjoin.nearest_stored(v.spark, path, rows.filter("id % 10 = 0"), 4, TOP_FLOOR)
    return near.select(F.col("query_id").alias("article_id"), "point_id", F.round("cosine", 6).alias("cosine"), long("rank").alias("rank"))


def _top1(v: Views) -> DataFrame:
    best = simjoin.best_recent(v.vectors, v.points, TOP_FLOOR, "last_updated_at", "as_of", P.event_hours)
    return best.join(v.points.select("point_id", "event_id"), "point_id").select(
        F.col("query_id").alias("article_id"), "event_id", "cosine"
    )


@query("event_top1", """
    SELECT article_id, event_id, round(cosine, 6) AS cosine FROM near_points WHERE rank = 1 AND cosine >= 0.25""")
def _(v):
    return _top1(v).withColumn("cosine", F.round("cosine", 6))


@query("posted_dedup", """
    SELECT a.article_id, round(coalesce(max(r.cosine), 0), 6) AS posted_cosine, coalesce(arg_max(r.url, r.cosine), '') AS matched_url,
      coalesce(max(r.cosine), 0) > 0.40 AS is_repeat FROM vectors a LEFT JOIN recent r USING (article_id) GROUP BY 1""")
def _(v):
    rows = dedup.posted_dedup(v.vectors, v.history, P.posted_floor, "as_of", P.posted_hours)
    return rows.select("article_id", F.round("posted_cosine", 6).alias("posted_cosine"), "matched_url", "is_repeat")


@query("similar_pairs", """
    SELECT batch_id, earlier, later, round(cosine, 6) AS cosine FROM batch_pairs WHERE cosine >= 0.30""")
def _(v):
    return simjoin.similar_pairs(v.vectors, 0.30).withColumn("cosine", F.round("cosine", 6))


@query("domain_source_join", """
    SELECT k.article_id, arg_min(s.source_id, s.source_order) AS matched_source FROM articles k
    LEFT JOIN sources s ON s.domain <> '' AND (regexp_extract(k.url, '://([^/?#]*)', 1) = s.domain
      OR ends_with(regexp_extract(k.url, '://([^/?#]*)', 1), '.' || s.domain)) GROUP BY 1""")
def _(v):
    rows = select.domain_source(v.articles, v.sources, host(F.col("url")), host_suffixes(F.col("host")))
    return rows.select("article_id", "matched_source")


@query("description_backfill", r"""
    SELECT a.article_id, CASE WHEN a.description <> '' THEN a.description ELSE coalesce(m.d, '') END AS description
    FROM (SELECT article_id, description, coalesce(p.url, a.url) AS url FROM articles a LEFT JOIN pages p ON p.page_id = a.article_id) a
    LEFT JOIN (SELECT url, max(d) AS d FROM (SELECT url, CASE WHEN page_id % 4 <> 1 THEN
        trim(regexp_replace(replace(replace(replace(translate('About ' ||
        regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '"''', ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) END AS d
      FROM pages) GROUP BY 1) m ON m.url = a.url""")
def _(v):
    """Articles that link to the pages by the pages' own addresses."""
    linked = v.table("pages").select(F.col("page_id").alias("article_id"), F.col("url").alias("page_url"))
    rows = v.articles.join(linked, "article_id", "left").withColumn("url", F.coalesce("page_url", "url"))
    return pages.description_backfill(rows, pages.page_meta(v.pages, P.cjk_meta_max)).select("article_id", "description")


def _judged(v: Views) -> DataFrame:
    rules = evidence.identity_verdict(
        v.reports, v.core.select("event_id", "token"), v.core, evidence.doc_freq(v.words),
        P.hub_events, P.pair_events_max, P.overlap_floor,
    )
    return evidence.verdict_join(rules, v.verdicts, WEIGHTS)


@query("verdict_join", """
    SELECT cluster_id, event_id, rule_verdict, accepted, CASE WHEN accepted THEN weight ELSE CAST(1.0 AS DOUBLE) END AS multiplier FROM judged""")
def _(v):
    return _judged(v).select("cluster_id", "event_id", "rule_verdict", "accepted", "multiplier")


@query("event_mark_published", """
    SELECT event_id, bool_or(event_id IN (SELECT event_id FROM near_points WHERE rank = 1 AND cosine >= 0.35)) AS published,
      max(published_s) AS updated_s FROM vectors GROUP BY 1""")
def _(v):
    best = simjoin.best_recent(v.vectors, v.points, P.related_floor, "last_updated_at", "as_of", P.event_hours)
    hit = best.join(v.points.select("point_id", "event_id"), "point_id")
    flags = state.mark_published(hit, v.latest)
    versions = v.points.select("event_id", "last_updated_at", F.lit(0).alias("cycle")).distinct()
    return tables.latest_events(versions, flags).select("event_id", "published", seconds("last_updated_at").alias("updated_s"))


# --- clustering ---------------------------------------------------------------------------------

GREEDY_SQL = """
    WITH RECURSIVE greedy AS (
      SELECT batch_id, min(seq) - 1 AS seq, [NULL::STRUCT(s BIGINT, c BIGINT, e DOUBLE[])][2:] AS kept,
        NULL::BIGINT AS cluster_seq, NULL::VARCHAR AS role FROM vectors GROUP BY 1
      UNION ALL
      SELECT batch_id, seq, CASE WHEN best >= 0.40 THEN kept ELSE list_append(kept, {'s': seq, 'c': CASE WHEN best >= 0.35 THEN home ELSE seq END, 'e': embedding}) END,
        CASE WHEN best >= 0.35 THEN home ELSE seq END,
        CASE WHEN best >= 0.40 THEN 'duplicate' WHEN best >= 0.35 THEN 'member' ELSE 'seed' END
      FROM (SELECT *, kept[list_position(sims, best)].c AS home FROM (
        SELECT *, greatest(coalesce(list_max(sims), 0.0), 0.0) AS best FROM (
          SELECT v.batch_id, v.seq, w.kept, v.embedding,
            list_transform(w.kept, lambda k: list_cosine_similarity(k.e, v.embedding)) AS sims
          FROM greedy w JOIN vectors v ON v.batch_id = w.batch_id AND v.seq = w.seq + 1))))
    """


@query("greedy_clusters", GREEDY_SQL + "SELECT batch_id, seq, cluster_seq, role FROM greedy WHERE role IS NOT NULL")
def _(v):
    return clustering.greedy_clusters(v.vectors, P.duplicate_floor, P.related_floor)


@query("greedy_clusters_joins", GREEDY_SQL + "SELECT batch_id, seq, cluster_seq, role FROM greedy WHERE role IS NOT NULL")
def _(v):
    """Every batch by joins, as batches of more than a block are."""
    return clustering.greedy_clusters(v.vectors, P.duplicate_floor, P.related_floor, block_rows=32)


@query("similarity_components", """
    WITH RECURSIVE edges AS (SELECT earlier AS a, later AS b FROM batch_pairs WHERE cosine >= 0.35
        UNION ALL SELECT later, earlier FROM batch_pairs WHERE cosine >= 0.35),
      reach AS (SELECT seq AS a, seq AS b FROM vectors UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
    SELECT v.batch_id, v.seq, min(r.b) AS component FROM vectors v JOIN reach r ON r.a = v.seq GROUP BY 1, 2""")
def _(v):
    return clustering.similarity_components(v.vectors, P.related_floor)


def _assigned(v: Views) -> DataFrame:
    placed = clustering.greedy_clusters(v.vectors, P.duplicate_floor, P.related_floor)
    return v.vectors.join(placed, ["batch_id", "seq"])


@query("cluster_summary", GREEDY_SQL + """
    SELECT w.batch_id, cluster_seq, array_to_string(list_sort(list(DISTINCT source_name)), ' ') AS sources, min(published_s) AS earliest_s,
      arg_min(source_name, published_s * 1000000 + w.seq) AS earliest_source,
      count(*) FILTER (role <> 'duplicate') AS members, count(*) FILTER (role = 'duplicate') AS duplicates
    FROM greedy w JOIN vectors v ON v.batch_id = w.batch_id AND v.seq = w.seq WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(v):
    rows = clustering.cluster_summary(_assigned(v))
    return rows.select(
        "batch_id", "cluster_seq", joined("sources").alias("sources"), seconds("earliest_at").alias("earliest_s"),
        "earliest_source", "members", "duplicates",
    )


@query("cluster_representative", GREEDY_SQL + """
    SELECT batch_id, cluster_seq, seq, seq = min(seq) OVER (PARTITION BY batch_id, cluster_seq) AS is_representative
    FROM greedy WHERE role IN ('seed', 'member') AND seq * 37 % 100 >= 50""")
def _(v):
    passed = _assigned(v).filter((F.col("role") != "duplicate") & ((F.col("seq") * 37) % 100 / 10.0 >= P.score_floor))
    return clustering.cluster_representative(passed).select("batch_id", "cluster_seq", "seq", "is_representative")


# --- evidence -----------------------------------------------------------------------------------

@query("weighted_overlap", "SELECT cluster_id, event_id, round(overlap, 9) AS overlap FROM overlap")
def _(v):
    rows = evidence.weighted_overlap(v.candidates, evidence.doc_freq(v.words), ["cluster_id", "event_id"])
    return rows.withColumn("overlap", F.round("overlap", 9))


@query("hub_token_score", "SELECT token, score FROM hub_score")
def _(v):
    return evidence.hub_token_score(v.hub_tokens)


@query("hub_token_increments", "SELECT token, score FROM hub_score")
def _(v):
    """The same scores from what four cycles added, the first two folded into one."""
    store = tables.Tables(v.spark, fresh_path(v.spark, "hub"))
    credits = cut(v.hub_tokens.withColumn("part", F.pmod(F.hash("event_id"), F.lit(4))))
    for cycle in range(4):
        mine = credits.filter(F.col("part") == cycle).drop("part")
        store.commit(cycle, {"hub_tokens": mine, "hub_counts": evidence.hub_counts(mine)})
    store.compact("hub_counts", 1)
    return evidence.token_scores(store.read("hub_counts"), credits)


@query("hub_pair_score", """
    SELECT p.token_a, p.token_b, count(b.event_id) AS score FROM (
      SELECT DISTINCT least(a, b) AS token_a, greatest(a, b) AS token_b FROM (
        SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (
          SELECT regexp_extract_all(lower(title || chr(10) || description), '[a-z'']+') AS t FROM articles)))
      WHERE a <> b) p
    JOIN hub_score x ON x.token = p.token_a JOIN hub_score y ON y.token = p.token_b
    JOIN hub a ON a.token = p.token_a LEFT JOIN hub b ON b.token = p.token_b AND b.event_id = a.event_id GROUP BY 1, 2""")
def _(v):
    words = F.regexp_extract_all(F.lower(text_fn.compare_text(F.col("title"), F.col("description"))), F.lit("[a-z']+"), F.lit(0))
    following = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    asked = v.spread_articles.select(words.alias("w")).filter(F.size("w") > 1).select(F.explode(following).alias("p")).select(
        F.least("p.a", "p.b").alias("token_a"), F.greatest("p.a", "p.b").alias("token_b")
    ).filter("token_a <> token_b").distinct()
    known = cut(evidence.hub_token_score(v.credits).select("token"))
    asked = asked.join(known.withColumnRenamed("token", "token_a"), "token_a", "left_semi").join(
        known.withColumnRenamed("token", "token_b"), "token_b", "left_semi"
    )
    return evidence.hub_pair_score(cut(asked), v.credits)


@query("hub_bump", """
    SELECT token, event_id FROM event_tokens WHERE df >= 2 AND NOT is_seed""")
def _(v):
    return evidence.hub_bump(v.hub_tokens, v.event_tokens.filter("is_seed").select("token", "event_id"))


@query("core_entities", "SELECT event_id, token FROM hub")
def _(v):
    rows = v.article_entities.select(
        "event_id", F.explode("entities").alias("token"), F.lit(1).alias("df"), (F.col("article_id") % 10 == 0).alias("is_seed")
    )
    return evidence.core_entities(rows, P.core_doc_freq)


@query("identity_verdict", "SELECT cluster_id, event_id, rule_verdict FROM rule")
def _(v):
    return _judged(v).select("cluster_id", "event_id", "rule_verdict")


@query("identity_walk", "SELECT cluster_id, matched_event_id, matched_cosine, multiplier, CASE WHEN matched_event_id IS NULL THEN n_links ELSE 0 END AS n_links FROM walk")
def _(v):
    return evidence.identity_walk(_judged(v)).select(
        "cluster_id", "matched_event_id", "matched_cosine", "multiplier", long(F.size("related_links")).alias("n_links")
    )


@query("heat_new_event", """
    SELECT batch_id, cluster_seq, CAST(1.0 + coalesce(sum(CASE WHEN source_name = earliest THEN 0.0
      WHEN source_name IN ('src0', 'src5', 'src10') THEN 2.0 ELSE 1.0 END), 0) AS DOUBLE) AS heat_score
    FROM (SELECT DISTINCT batch_id, cluster_seq, source_name, arg_min(source_name, published_s * 1000000 + seq) OVER (PARTITION BY batch_id, cluster_seq) AS earliest
      FROM cluster_in) GROUP BY 1, 2""")
def _(v):
    rows = _summary(v)
    score = heat.heat_new_event(F.col("sources"), F.col("earliest_source"), MAJOR, P.major_weight)
    return rows.select("batch_id", "cluster_seq", score.alias("heat_score"))


def _labelled(v: Views) -> DataFrame:
    """Clusters given by a label instead of by similarity, so that they have many sources."""
    role = F.when(F.col("seq") % 3 == 2, "duplicate").otherwise("member")
    return v.vectors.withColumns({"cluster_seq": F.col("label").cast("bigint"), "role": role})


def _summary(v: Views) -> DataFrame:
    return clustering.cluster_summary(_labelled(v))


@query("heat_update", """
    SELECT c.label AS cluster_seq, c.batch_id, CAST(2.5 + 1.5 * coalesce(sum(CASE WHEN o.source_name IS NOT NULL THEN 0.0
      WHEN c.source_name IN ('src0', 'src5', 'src10') THEN 2.0 ELSE 1.0 END), 0) AS DOUBLE) AS heat_score
    FROM (SELECT DISTINCT batch_id, label, source_name FROM vectors) c
    LEFT JOIN (SELECT DISTINCT batch_id, label, source_name FROM vectors) o
      ON o.batch_id = c.batch_id AND o.label = (c.label + 1) % 10 AND o.source_name = c.source_name GROUP BY 1, 2""")
def _(v):
    rows = _summary(v)
    credited = rows.select("batch_id", ((F.col("cluster_seq") + 9) % 10).alias("cluster_seq"), F.col("sources").alias("credited"))
    both = rows.join(credited, ["batch_id", "cluster_seq"], "left")
    empty = F.array().cast("array<string>")
    score = heat.heat_update(
        F.lit(2.5), F.col("sources"), F.coalesce("credited", empty), F.lit(1.5), MAJOR, P.major_weight
    )
    return both.select(F.col("cluster_seq").cast("int").alias("cluster_seq"), "batch_id", F.round(score, 6).alias("heat_score"))


@query("entity_doc_freq", "SELECT event_id, token, df FROM event_tokens")
def _(v):
    return state.entity_doc_freq(v.article_entities)


def _commit(v: Views, merged: bool) -> dict[str, DataFrame]:
    """Batches after the first continue the label's event of the first batch, or share one event per parity."""
    summary = _summary(v).withColumn("cluster_id", F.col("batch_id") * 100 + F.col("cluster_seq"))
    name = F.col("cluster_seq") % 2 if merged else F.col("cluster_seq")
    known = F.concat(F.lit("k"), name.cast("string"))
    clusters = summary.filter("batch_id > 0").select(
        "cluster_id", F.when((F.col("cluster_seq") < 8) & (F.lit(merged) | (F.col("batch_id") == 1)), known).alias("matched_event_id"),
        F.when(F.col("cluster_seq") % 3 == 0, 0.2).otherwise(1.5).alias("multiplier"), "sources", "earliest_source", "earliest_at",
        F.array().cast("array<struct<event_id:string,cosine:double>>").alias("related_links"),
    )
    old = _labelled(v).filter("batch_id = 0").withColumn("event_id", known)
    events = old.groupBy("event_id").agg(
        F.lit(3.0).alias("heat_score"), F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at"),
    ).select("*", *[F.lit("old").alias(c) for c in (
        "representative_text", "canonical_title", "canonical_summary", "event_type", "canonical_action", "actor", "target")])
    sources = old.filter("role <> 'duplicate'").select("event_id", "source_name").distinct()
    survivors = _labelled(v).filter("batch_id > 0 AND role <> 'duplicate'").select(
        (F.col("batch_id") * 100 + F.col("cluster_seq")).alias("cluster_id"), "seq", "article_id", "url",
        url_hash(F.col("url")).alias("url_hash"), "source_name", "published_at", F.concat(F.lit("t"), "seq").alias("title"),
        F.lit("").alias("description"), F.concat(F.lit("x"), "seq").alias("text"),
        F.array(F.concat(F.lit("w"), (F.col("seq") % 7).cast("string"))).alias("entities"), "embedding",
        F.lit("meeting").alias("event_type"), *[F.lit(None).cast("string").alias(c) for c in ("action", "actor", "target")],
    )
    no_tokens = v.event_tokens.filter(F.lit(False))
    return state.event_commit(
        clusters, survivors, events, sources, no_tokens, v.hub_tokens.filter(F.lit(False)), v.latest, F.lit(7),
        MAJOR, P.major_weight, P.core_doc_freq,
    )


def _commit_sql(event: str, known: str) -> str:
    return f"""
    SELECT d.event_id, CAST(coalesce(o.heat, 1.0) + d.gain AS DOUBLE) AS heat_score, least(o.first_s, d.first_s) AS first_seen_s,
      d.rep AS representative_text, coalesce(o.title, d.seed) AS canonical_title, coalesce(o.title, 'meeting') AS event_type
    FROM (SELECT event_id, min(first_s) AS first_s, arg_max(rep, cluster_id) AS rep, arg_min(seed, cluster_id) AS seed,
        (SELECT coalesce(sum(CASE WHEN fresh.is_new AND fresh.source_name = fresh.earliest THEN 0.0 ELSE
            (CASE WHEN fresh.source_name IN ('src0', 'src5', 'src10') THEN 2.0 ELSE 1.0 END) * CASE WHEN fresh.is_new THEN 1.0 ELSE fresh.m END END), 0.0)
         FROM fresh WHERE fresh.event_id = joined_.event_id) AS gain
      FROM joined_ GROUP BY 1) d
    LEFT JOIN (SELECT {known} AS event_id, 3.0 AS heat, min(published_s) AS first_s, 'old' AS title
      FROM cluster_in WHERE batch_id = 0 GROUP BY 1) o USING (event_id)"""


def _commit_with(event: str, known: str) -> str:
    return f"""
    WITH RECURSIVE one AS (SELECT batch_id * 100 + cluster_seq AS cluster_id, cluster_seq, batch_id,
        min(published_s) AS first_s, arg_min(source_name, published_s * 1000000 + seq) AS earliest,
        'x' || min(seq) FILTER (role <> 'duplicate') AS rep, 't' || min(seq) FILTER (role <> 'duplicate') AS seed,
        arg_min(url, seq) FILTER (role <> 'duplicate') AS seed_url
      FROM cluster_in WHERE batch_id > 0 GROUP BY 1, 2, 3),
    joined_ AS (SELECT *, {event} IS NULL AS is_new, coalesce({event}, sha256(sha256(seed_url) || '|7')) AS event_id,
        CASE WHEN cluster_seq % 3 = 0 THEN 0.2 ELSE 1.5 END AS m FROM one WHERE rep IS NOT NULL),
    fresh AS (SELECT j.event_id, c.source_name, arg_min(j.is_new, j.cluster_id) AS is_new, arg_min(j.m, j.cluster_id) AS m,
        arg_min(j.earliest, j.cluster_id) AS earliest
      FROM joined_ j JOIN cluster_in c ON c.batch_id = j.batch_id AND c.cluster_seq = j.cluster_seq
      WHERE NOT EXISTS (SELECT 1 FROM cluster_in o WHERE o.batch_id = 0 AND o.role <> 'duplicate'
        AND {known.replace('cluster_seq', 'o.cluster_seq')} = j.event_id AND o.source_name = c.source_name)
      GROUP BY 1, 2)""" + _commit_sql(event, known)


def _commit_rows(changes: dict[str, DataFrame]) -> DataFrame:
    return changes["events"].select(
        "event_id", F.round("heat_score", 6).alias("heat_score"), seconds("first_seen_at").alias("first_seen_s"),
        "representative_text", "canonical_title", "event_type",
    )


@query("event_commit", _commit_with("CASE WHEN cluster_seq < 8 AND batch_id = 1 THEN 'k' || cluster_seq END", "'k' || cluster_seq"))
def _(v):
    return _commit_rows(_commit(v, merged=False))


@query("event_commit_merge", _commit_with("CASE WHEN cluster_seq < 8 THEN 'k' || (cluster_seq % 2) END", "'k' || (cluster_seq % 2)"))
def _(v):
    return _commit_rows(_commit(v, merged=True))


@query("cluster_gate", """
    SELECT batch_id * 100 + cluster_seq AS cluster_id, count(*) AS n FROM cluster_in GROUP BY 1
    HAVING bool_or(seq * 37 % 100 / 10.0 >= 9.5)""")
def _(v):
    rows = _labelled(v).withColumns({
        "cluster_id": F.col("batch_id") * 100 + F.col("cluster_seq"), "score": (F.col("seq") * 37) % 100 / 10.0,
    })
    clusters = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return state.cluster_gate(clusters, rows, 9.5)


@query("funnel_report", """
    SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_raw, CAST(sum(n_fresh) AS BIGINT) AS n_fresh, count(*) FILTER (kept) AS n_new,
      count(*) FILTER (kept AND english) AS n_english, count(*) FILTER (kept AND english AND score >= 5.0) AS n_passed
    FROM (SELECT *, n_fresh > 0 AND NOT claimed AS kept FROM (
      SELECT batch_id, url_hash, count(*) AS n, count(*) FILTER (fresh) AS n_fresh,
        arg_min(length(t) < 20 OR coalesce(detected, 'en') = 'en', seq) FILTER (fresh) AS english, arg_min(score, seq) FILTER (fresh) AS score,
        coalesce(any_value(claimed_s) > max(now_s) - 864000, false) AS claimed
      FROM (SELECT k.*, detected, claimed_s, max(published_s) OVER (PARTITION BY batch_id) AS now_s,
          published_s >= max(published_s) OVER (PARTITION BY batch_id) - 10800 AS fresh,
          regexp_replace(title || ' ' || description, '^\\s+|\\s+$', '', 'g') AS t
        FROM keyed k LEFT JOIN detected USING (article_id) LEFT JOIN (
          SELECT url_hash, max((SELECT max(published_s) FROM articles) - CASE WHEN quality = 1 THEN 9 ELSE 11 END * 86400) AS claimed_s
          FROM keyed JOIN labels ON doc_id = article_id WHERE toxic = 1 GROUP BY 1) c USING (url_hash))
      GROUP BY 1, 2)) GROUP BY 1""")
def _(v):
    clock = v.articles.groupBy("batch_id").agg(F.max("published_at").alias("as_of"))
    found = v.detected(v.headlines.select("article_id", "text")).withColumnRenamed("detected", "lang")
    # The texts' part of the English rule goes through the joins in place of the texts.
    by_text = lang_fn.english_by_text(F.concat_ws(" ", "title", "description"), P.cjk_max, P.min_language_chars)
    rows = v.spread_articles.select("article_id", "batch_id", "seq", "url", "published_at", "score", by_text.alias("by_text"))
    rows = rows.join(found, "article_id", "left").join(clock, "batch_id")
    english = lang_fn.english_of(F.col("by_text"), F.col("lang"))
    return ingest.funnel_report(rows, _claims(v), "as_of", P, ["batch_id"], english)


@query("token_overlap", """
    SELECT cluster_id, event_id, array_to_string(list_sort(list_intersect(tokens_a, tokens_b)), ' ') AS shared FROM candidates""")
def _(v):
    return v.candidates.select("cluster_id", "event_id", joined(F.array_intersect("tokens_a", "tokens_b")).alias("shared"))


# --- entities and pages -------------------------------------------------------------------------

@query("entity_tokens", f"""
    SELECT DISTINCT article_id, token FROM (
      SELECT article_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(pattern, '^["''“”‘’]+|["''“”‘’]+$', '', 'g'), '(’s|''s)$', '')), '[a-z'']+')) AS token
      FROM hits WHERE length(pattern) >= 2) WHERE length(token) > 1 AND token NOT IN (
      'the','a','an','of','in','on','at','to','for','and','or','is','are','was','were','be','as','by','with','from',
      'that','this','it','its','their','his','her','he','she','they','you','i')""")
def _(v):
    return entities.entity_tokens(v.texts, v.patterns, "article_id")


_LEXICON = entities.EVENT_VERBS | {verb: kind for kind, verbs in LEXICON.items() for verb in verbs}
_FORMS_SQL = f"""
    forms AS (SELECT form, verb, event_type, min(rule) AS rule FROM (
      SELECT verb, event_type, unnest(range(len(f))) AS rule, unnest(f) AS form FROM (
        SELECT verb, event_type, list_concat([verb,
            CASE WHEN regexp_matches(verb, '[^aeiou]y$') THEN verb[:-2] || 'ies' WHEN regexp_matches(verb, '(s|x|z|ch|sh|o)$') THEN verb || 'es' ELSE verb || 's' END,
            CASE WHEN verb LIKE '%e' THEN verb || 'd' WHEN regexp_matches(verb, '[^aeiou]y$') THEN verb[:-2] || 'ied' ELSE verb || 'ed' END,
            CASE WHEN verb LIKE '%ie' THEN verb[:-3] || 'ying' WHEN regexp_matches(verb, '[^eoy]e$') THEN verb[:-2] || 'ing' ELSE verb || 'ing' END,
            CASE WHEN regexp_matches(verb, '[^aeiou][aeiou][bcdfghjklmnpqrtvz]$') THEN verb || verb[-1] || 'ed' END,
            CASE WHEN regexp_matches(verb, '[^aeiou][aeiou][bcdfghjklmnpqrtvz]$') THEN verb || verb[-1] || 'ing' END],
          coalesce(irregular, [])) AS f
        FROM (SELECT unnest({list(_LEXICON)!r}) AS verb, unnest({list(_LEXICON.values())!r}) AS event_type)
        LEFT JOIN (SELECT unnest({list(entities.IRREGULAR)!r}) AS verb, unnest({[list(x) for x in entities.IRREGULAR.values()]!r}) AS irregular) USING (verb)))
      WHERE form IS NOT NULL GROUP BY 1, 2, 3)"""
_FIRST_WORDS_SQL = r"""
    first_words AS (SELECT article_id, list_transform(regexp_split_to_array(s, '\s+'), lambda w: regexp_replace(regexp_replace(
        regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$', '', 'g'), '(’s|''s)$', ''), '(\p{Ll})\.$', '\1')) AS ws
      FROM (SELECT article_id, regexp_replace(regexp_extract(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^(?s:(.*?))(?:[.!?]\s|\n|$)', 1)
        || coalesce(regexp_extract(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^(?s:.*?)(?:([.!?])\s|\n|$)', 1), ''), '^\s+|\s+$', '', 'g') AS s
        FROM (SELECT doc_id AS article_id, 'They ' || {said}[doc_id % {n} + 1] || ' ' || text AS t FROM documents WHERE lang = 'en')))
    """.replace("{said}", repr(list(SAID))).replace("{n}", str(len(SAID)))


@query("event_type_tag", f"""
    WITH RECURSIVE {_FORMS_SQL}, {_FIRST_WORDS_SQL}
    SELECT article_id, arg_min(event_type, k) AS event_type, arg_min(verb, k) AS verb FROM (
      SELECT article_id, pos * 100 + rule AS k, f.verb, f.event_type
      FROM (SELECT article_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM first_words) JOIN forms f ON f.form = lower(w)) GROUP BY 1""")
def _(v):
    return entities.verb_hits(v.reported.filter("lang = 'en'"), v.verbs, "article_id").select("article_id", "event_type", "verb")


@query("actor_target")
def _(v):
    rows = v.texts.withColumn("is_english", F.col("lang") == "en")
    return entities.event_frame(rows, v.patterns, v.verbs, "article_id")


@query("tfidf_vectors")
def _(v):
    from newsflow.operators.tfidf import tfidf_vectors

    rows = tfidf_vectors(v.texts, "article_id", 256)
    return rows.select("article_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


_TITLE = """translate(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '"''', '')"""
_PLAIN = """regexp_replace(regexp_replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"""


@query("page_meta", f"""
    SELECT page_id, CASE WHEN page_id % 7 = 3 THEN NULL ELSE {_PLAIN.format(_TITLE)} END AS preview_title,
      CASE WHEN page_id % 4 <> 1 THEN {_PLAIN.format("'About ' || " + _TITLE)} END AS preview_description,
      CASE WHEN page_id % 3 = 0 THEN 'https://img.example.com/' || page_id || '.jpg' END AS preview_image, url AS preview_url FROM pages""")
def _(v):
    return pages.page_meta(v.pages, P.cjk_meta_max).select(
        "page_id", "preview_title", "preview_description", "preview_image", "preview_url"
    )


@query("page_image", """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://img.example.com/' || page_id || '.jpg'
      WHEN 1 THEN 'https://next.example.com/' || page_id ELSE 'https://cdn.example.com/p/' || page_id || '.png' END AS preview_image FROM pages""")
def _(v):
    return pages.page_image(pages.page_meta(v.pages, P.cjk_meta_max)).select("page_id", "preview_image")


@query("page_text", r"""
    SELECT page_id, regexp_replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(string_split(
        regexp_replace(regexp_replace(regexp_replace(a, '(?i)</?(article|body|div|h[1-6]|html|li|p|ul)\b[^>]*>', chr(1), 'g'), '(?i)<br\b[^>]*>', ' ', 'g'),
          '(?s)</?[a-zA-Z!?][^>]*>', '', 'g'), chr(1)),
        lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&amp;?', '&', 'g') AS page_text
    FROM (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
        '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<h1\b[^>]*>.*?</h1\s*>', ' ', 'g'),
        '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS a FROM pages)""")
def _(v):
    return pages.page_text(v.texts_of("pages")).select("page_id", "page_text")


# --- selection ----------------------------------------------------------------------------------

def _batch(v: Views) -> DataFrame:
    rows = select.pool_eligible(v.pool, "as_of", P.pool_hours, P.pool_score_floor)
    return select.tiered_batch(rows, "as_of", P, ["cycle"])


@query("tiered_batch", "SELECT cycle, article_id, tier, batch_rank FROM batch")
def _(v):
    return _batch(v).select("cycle", "article_id", "tier", long("batch_rank").alias("batch_rank"))


@query("priority_rank", "SELECT cycle, article_id, priority_score, rank FROM ranked")
def _(v):
    rows = select.priority_rank(_batch(v), _rank_raw(v), ["cycle"])
    c = F.col("cycle") % 3
    score = F.when(c == 2, 0.0).otherwise(F.col("priority_score"))
    return rows.select("cycle", "article_id", score.alias("priority_score"), long("rank").alias("rank"))


@query("publish_winner", """
    SELECT cycle, article_id FROM (SELECT r.cycle, r.article_id, row_number() OVER (PARTITION BY r.cycle ORDER BY r.rank) AS n
      FROM ranked r LEFT JOIN (SELECT article_id, max(cosine) AS c FROM recent GROUP BY 1) p USING (article_id)
      WHERE coalesce(p.c, 0) <= 0.30) WHERE n = 1""")
def _(v):
    ranked = select.priority_rank(_batch(v), _rank_raw(v), ["cycle"])
    checked = dedup.posted_dedup(v.vectors, v.history, 0.30, "as_of", P.posted_hours).select("article_id", "is_repeat")
    rows = ranked.join(checked, "article_id", "left").withColumn("is_repeat", F.coalesce("is_repeat", F.lit(False)))
    return select.publish_winner(rows, ["cycle"]).select("cycle", "article_id")


ALERTS_SQL = """
    WITH RECURSIVE tries AS (SELECT 'src' || (user_id % 20) AS source_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error' AND user_id % 20 <> 3),
    chain AS (SELECT source_id, min(t) AS t FROM tries GROUP BY 1
      UNION ALL SELECT c.source_id, min(e.t) FROM chain c JOIN tries e ON e.source_id = c.source_id AND e.t >= c.t + 21600000000 GROUP BY c.source_id, c.t)
    SELECT source_id, t AS sent_us FROM chain"""


def alert_attempts(v: Views) -> DataFrame:
    n = F.col("user_id") % 20
    return v.table("events").select(
        F.when(n == 3, "").otherwise(F.concat(F.lit("src"), n.cast("string"))).alias("source_id"), F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_type") != "error").alias("delivered"), F.col("event_id").cast("bigint").alias("attempt_id"),
    )


@query("alert_debounce", ALERTS_SQL)
def _(v):
    sent = dedup.alerts_to_send(alert_attempts(v), P.alert_cooldown_seconds)
    return sent.select("source_id", F.unix_micros("sent_at").alias("sent_us"))


@query("late_drop", """
    SELECT article_id, batch_id FROM (SELECT *, max(published_s) OVER (PARTITION BY batch_id) AS as_of_s FROM articles)
    WHERE published_s >= as_of_s - 10800""")
def _(v):
    from newsflow.streaming.jobs import late_drop

    clock = v.articles.groupBy("batch_id").agg(F.max("published_at").alias("as_of"))
    return late_drop(v.articles.join(clock, "batch_id"), "as_of", P.max_publish_age_hours).select("article_id", "batch_id")
