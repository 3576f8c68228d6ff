"""Derived tables for the registered queries, built from the driver tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import compare_text, word_tokens
from newsflow.functions.urls import url_hash
from newsflow.operators import entities, language
from newsflow.session import cut, prepare

BASE = 1_704_067_200  # 2024-01-01 00:00:00 UTC
STEP = 300  # seconds between articles
LEXICON = {"statement": ("er", "thr"), "attack": ("re", "wh"), "meeting": ("rest", "ou"), "protest": ("ther",)}
#: Words put into first sentences: forms of lexicon verbs, and some that are none.
SAID = (
    "banned", "denied", "denies", "won", "met", "led", "struck", "ripped", "slammed", "rallied", "winning", "announces", "sued", "vetoes",
    "booing", "today", "upheld", "plunging", "imposing", "quickly", "sentenced", "indicting", "backs", "settles", "deported",
)
MAJOR = ("src0", "src5", "src10")


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def text_of(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def identity_tokens(words: Column) -> Column:
    """The words that may tell an event: stop words and single letters left out."""
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*entities.STOPWORDS))


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts_of(self, name: str) -> DataFrame:
        """A table of texts, spread over all cores when it has fewer splits than there are cores.

        A file of one row group is one task, whatever its size; a table of many files stays as it is.
        """
        rows, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    @cached_property
    def articles(self) -> DataFrame:
        return self._articles(self.table("documents"))

    @cached_property
    def spread_articles(self) -> DataFrame:
        """The same rows for queries that work through the text of every article."""
        return self._articles(self.texts_of("documents"))

    def _articles(self, documents: DataFrame) -> DataFrame:
        d = F.col("doc_id")
        n = F.when((d % 40).isin(23, 27, 31, 35), d - 20).otherwise(d)
        suffix = F.when(d % 3 == 1, text_of("?u=", d)).when(d % 3 == 2, F.lit("#s")).otherwise("")
        return documents.select(
            d.alias("article_id"), d.alias("seq"), F.expr("doc_id DIV 50").alias("batch_id"),
            F.col("source").alias("source_name"), "lang", F.when(d % 9 == 0, F.col("text")).otherwise(F.substring("text", 1, 80)).alias("title"),
            F.when(d % 9 == 0, "").otherwise(F.expr("substring(text, 81)")).alias("description"),
            F.concat(text_of("https://www.src", n % 20, ".example.com/a/", n), suffix).alias("url"),
            at(d * STEP + BASE).alias("published_at"),
            ((d * 37) % 100 / 10.0).cast("double").alias("score"), "text",
        )

    @cached_property
    def latest(self) -> Column:
        return self.articles.agg(F.max("published_at").alias("m")).scalar()

    @cached_property
    def headlines(self) -> DataFrame:
        mark = F.when(F.col("article_id") % 13 == 0, F.lit("习惯高油价吧 - ")).otherwise("")
        return self.spread_articles.select("article_id", "lang", F.concat(mark, "title", F.lit(" "), "description").alias("text"))

    @cached_property
    def tokens(self) -> DataFrame:
        return self.spread_articles.select(
            "article_id", "batch_id", word_tokens(F.concat_ws(" ", "title", "description")).alias("tokens")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        seconds = v * STEP + BASE
        return self.table("embeddings").select(
            v.alias("article_id"), v.alias("seq"), F.expr("vec_id DIV 250").alias("batch_id"),
            text_of("src", v % 20).alias("source_name"), "label", at(seconds).alias("published_at"),
            at(F.floor(seconds / 28_800) * 28_800).alias("as_of"), "embedding",
            text_of("https://www.src", v % 20, ".example.com/v/", v).alias("url"),
            F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("_"), F.expr("vec_id DIV 50").cast("string")).alias("event_id"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return self.vectors.select(F.col("article_id").alias("point_id"), "url", "published_at", "embedding")

    @cached_property
    def points(self) -> DataFrame:
        updated = self.vectors.groupBy("event_id").agg(F.max("published_at").alias("last_updated_at"))
        return self.vectors.select(F.col("article_id").alias("point_id"), "event_id", "embedding").join(updated, "event_id")

    @cached_property
    def pool(self) -> DataFrame:
        d = F.col("article_id")
        rows = self.articles.select(
            "article_id", "seq", F.expr("article_id DIV 200").alias("cycle"), "title", "description", "url", "source_name",
            "score", F.when(d % 29 != 0, F.col("published_at")).alias("published_at"),
            (F.col("published_at") + F.expr("INTERVAL 600 SECOND")).alias("created_at"),
            F.when(d % 4 == 1, 0.0).when(d % 4 > 1, (d % 7) * 0.5).cast("double").alias("heat_score"),
            F.when(d % 3 != 0, at(d * STEP + BASE - 3600 * (d % 5))).alias("event_first_seen_at"), "text",
        )
        clock = rows.groupBy("cycle").agg(F.max("created_at").alias("as_of"))
        return rows.join(clock, "cycle")

    @cached_property
    def send_log(self) -> DataFrame:
        return self.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("article_id"))

    @cached_property
    def generated(self) -> DataFrame:
        d = F.col("article_id")
        return self.articles.select(
            "article_id", "url",
            F.when(d % 5 == 0, "**No comment**.").when(d % 5 == 1, " _no Comment_! ")
            .otherwise(F.col("text")).alias("generated"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        d, s = F.col("article_id"), F.col("score").cast("string")
        return self.articles.select(
            "article_id", "score",
            F.when(d % 6 == 0, F.concat(F.lit('{"llm_score": '), s, F.lit(', "llm_comment": "ok"}')))
            .when(d % 6 == 1, F.concat(F.lit('{"llm_score": "'), s, F.lit('", "llm_comment": "text"}')))
            .when(d % 6 == 2, "I rate this 7").when(d % 6 == 3, '{"llm_score": 4}')
            .when(d % 6 == 4, '{"llm_score": 4, "llm_comment": 5}')
            .otherwise(F.concat(F.lit('{"llm_comment": "", "llm_score": '), s, F.lit("}"))).alias("score_raw"),
            F.when(d % 12 == 2, '{"llm_score": 6, "llm_comment": "again"}').alias("score_retry_raw"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        names = self.table("documents").select("source").distinct()
        n = F.substring("source", 4, 9).cast("bigint")
        return names.select(
            F.col("source").alias("source_id"), n.alias("source_order"),
            F.when(n % 5 == 3, "").otherwise(F.upper("source")).alias("name"),
            F.when(n % 7 == 6, "").otherwise(text_of("https://feeds.", F.col("source"), ".example.com/rss")).alias("feed_url"),
            F.when(n % 6 == 5, "").otherwise(text_of(F.col("source"), ".example.com")).alias("domain"),
            (n % 9 != 4).alias("in_use"),
        )

    @cached_property
    def names(self) -> DataFrame:
        """Gazetteer input from the first two words of each benchmark passage."""
        i, w = F.col("item_id"), F.split("text", " ")
        return self.table("benchmark").select(
            F.when(i % 4 == 0, "congress").when(i % 4 == 1, "cabinet").when(i % 4 == 2, "notable").otherwise("alias").alias("kind"),
            F.concat(w[0], F.lit(" "), w[1]).alias("full_name"),
            F.when(i % 8 != 2, w[1]).alias("last_name"),
            (i % 5 == 0).alias("ambiguous"),
        )

    @cached_property
    def patterns(self) -> DataFrame:
        return entities.gazetteer_patterns(self.names)

    @cached_property
    def texts(self) -> DataFrame:
        return self.texts_of("documents").select(F.col("doc_id").alias("article_id"), "text", "lang")

    @cached_property
    def profiles(self) -> DataFrame:
        """Language profiles of two cycles of labelled texts, a third of them held out by the checksum of their ids."""
        d = F.col("article_id")
        learned = self.texts.filter(F.crc32(d.cast("string")) % 3 != 1)
        parts = [language.profile_counts(learned.filter(d % 2 == n)) for n in (0, 1)]
        return cut(language.profiles_of(language.merged_counts(parts)))

    def detected(self, texts: DataFrame) -> DataFrame:
        """`article_id, detected` of rows with a text, from the text alone."""
        return language.detect_language(texts, self.profiles, "article_id")

    @cached_property
    def reported(self) -> DataFrame:
        """Texts whose first sentence begins with a reporter's word."""
        word = F.get(F.split(F.lit(" ".join(SAID)), " "), (F.col("article_id") % len(SAID)).cast("int"))
        return self.texts.withColumn("text", F.concat(F.lit("They "), word, F.lit(" "), "text"))

    @cached_property
    def verbs(self) -> DataFrame:
        """The whole lexicon, and word fragments that the invented texts have."""
        return entities.lexicon(self.spark, entities.EVENT_VERBS | {verb: kind for kind, verbs in LEXICON.items() for verb in verbs})

    @cached_property
    def article_entities(self) -> DataFrame:
        """Identity tokens of an article: the words of its whole text, stop words left out."""
        keep = identity_tokens(word_tokens(compare_text(F.col("title"), F.col("description"))))
        return self.spread_articles.select(
            "article_id", "seq", "batch_id", "title", "description",
            text_of("ev", F.expr("article_id DIV 10")).alias("event_id"), keep.alias("entities"),
        )

    @cached_property
    def event_tokens(self) -> DataFrame:
        rows = self.article_entities.select("event_id", "article_id", F.explode("entities").alias("token"))
        return rows.groupBy("event_id", "token").agg(
            F.count("*").alias("df"), F.bool_or(F.col("article_id") % 10 == 0).alias("is_seed")
        )

    @cached_property
    def hub_tokens(self) -> DataFrame:
        return self.event_tokens.filter("is_seed OR df >= 2").select("token", "event_id")

    @cached_property
    def credits(self) -> DataFrame:
        """The core tokens written once, for queries that read them several times."""
        return cut(self.hub_tokens)

    @cached_property
    def event_texts(self) -> DataFrame:
        return self.article_entities.groupBy("event_id").agg(
            F.max_by(F.concat_ws("\n", "title", "description"), "article_id").alias("representative_text")
        )

    @property
    def _asked(self) -> DataFrame:
        """Each article against the two events before its own, with the texts of both.

        Every eleventh article is one whose tokens could not be read; half of these have no text to compare either,
        a third quote the event's text before their title.
        """
        # The text travels through the joins; its token array is several times larger.
        d = F.col("article_id")
        rows = self.article_entities.select(
            d.alias("cluster_id"), "batch_id", (d % 11 == 5).alias("unread"), (d % 22 != 5).alias("has_texts"), "entities", "title",
            compare_text(F.col("title"), F.col("description")).alias("text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"),
        ).withColumn("event_id", F.concat(F.lit("ev"), (F.expr("cluster_id DIV 10") - F.col("rank")).cast("string")))
        quoting = F.col("unread") & (F.col("cluster_id") % 3 == 0)
        return rows.join(self.event_texts, "event_id").withColumns({
            "text": F.when(quoting, F.concat_ws("\n", "representative_text", "title")).otherwise(F.col("text")),
            "cosine": (1.0 - F.col("rank") * 0.125).cast("double"),
        })

    @cached_property
    def words(self) -> DataFrame:
        """The words of every text, found once and written."""
        d = F.col("article_id")
        return cut(self.spread_articles.select(
            "article_id", "batch_id", F.expr("article_id DIV 10").alias("event_no"),
            F.when((d % 11 == 5) & (d % 3 == 0), F.coalesce("title", F.lit(""))).alias("quoting"),
            word_tokens(compare_text(F.col("title"), F.col("description"))).alias("tokens"),
        ))

    @cached_property
    def core(self) -> DataFrame:
        """The core tokens once more, from words that are written already."""
        rows = self.words.select("event_no", (F.col("article_id") % 10 == 0).alias("is_seed"), F.explode(identity_tokens(F.col("tokens"))).alias("token"))
        found = rows.groupBy("event_no", "token").agg(F.count("*").alias("df"), F.bool_or("is_seed").alias("is_seed")).filter("is_seed OR df >= 2")
        return cut(found.select("token", text_of("ev", F.col("event_no")).alias("event_id")))

    def _pairs(self) -> DataFrame:
        """Each article against the two events before its own, with the words of both; the words of a text are found once, not per pair.

        Every eleventh article is one whose tokens could not be read; half of these have no text to compare either,
        a third quote the event's text before their title.
        """
        from newsflow.operators.evidence import doc_count

        # The events, of which there are fewer, travel to both of their reports' numbers.
        events = self.words.groupBy("event_no").agg(F.max_by("tokens", "article_id").alias("tokens_b")).select(
            text_of("ev", F.col("event_no")).alias("event_id"), "tokens_b",
            F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "event_no",
        ).withColumn("event_no", F.col("event_no") + F.col("rank"))
        quoted = F.array_distinct(F.concat("tokens_b", word_tokens(F.col("quoting"))))
        return self.words.join(events, "event_no").join(doc_count(self.words), "batch_id").withColumn(
            "tokens_a", F.when(F.col("quoting").isNotNull(), quoted).otherwise(F.col("tokens"))
        ).withColumnRenamed("article_id", "cluster_id")

    @cached_property
    def candidates(self) -> DataFrame:
        """All pairs of report and event with the words of both."""
        return self._pairs().select("batch_id", "cluster_id", "event_id", "tokens_a", "tokens_b", "n_docs")

    @cached_property
    def reports(self) -> DataFrame:
        """The pairs as the identity rules read them: words of both only where the report has no tokens."""
        none, d = F.array().cast("array<string>"), F.col("cluster_id")
        unread, has_texts, entities = d % 11 == 5, d % 22 != 5, identity_tokens(F.col("tokens"))
        compared = (unread | (F.size(entities) == 0)) & has_texts
        # Read several times: the words of a few pairs and the tokens of all, written once.
        return cut(self._pairs().select(
            "batch_id", "cluster_id", "event_id", "rank", (1.0 - F.col("rank") * 0.125).cast("double").alias("cosine"),
            F.when(unread, none).otherwise(entities).alias("new_tokens"),
            F.when(compared, F.col("tokens_a")).otherwise(none).alias("tokens_a"),
            F.when(compared, F.col("tokens_b")).otherwise(none).alias("tokens_b"), has_texts.alias("has_texts"), "n_docs",
        ))

    @cached_property
    def verdicts(self) -> DataFrame:
        q, x = F.col("quality"), F.col("toxic")
        return self.table("labels").select(
            F.col("doc_id").alias("cluster_id"),
            F.concat(F.lit("ev"), (F.expr("doc_id DIV 10") - 1).cast("string")).alias("event_id"),
            F.when(q == 1, "VERDICT: SAME_EVENT\nREASON: x").otherwise("reason: y\nverdict (final): different_event").alias("same_raw"),
            F.when(x == 1, "SUBTYPE: CORE_UPDATE").otherwise("Subtype: restatement").alias("subtype_raw"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Articles as feed items and entries in XML text, with the date written in several ways."""
        d = F.col("article_id")
        esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        day = lambda fmt, shift=0: F.date_format(F.col("published_at") + F.expr(f"INTERVAL {shift} SECOND"), fmt)
        date = (
            F.when(d % 5 == 0, F.concat(day("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(d % 5 == 1, F.concat(day("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(d % 5 == 2, F.concat(day("EEE, dd MMM yyyy HH:mm:ss", 7200), F.lit(" +0200")))
            .when(d % 5 == 3, day("yyyy-MM-dd HH:mm:ss")).otherwise("soon")
        )
        updated = F.when((d % 5 == 4) & (d % 2 == 0), day("dd MMM yyyy HH:mm:ss", -18000)).otherwise("")
        zoned = F.when(updated != "", F.concat(updated, F.lit(" EST"))).otherwise("")
        link = F.when(d % 17 == 5, "").otherwise(F.col("url"))
        tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
        # Every seventh is an entry: two links in attributes, and other names for the text and the dates.
        href = lambda rel, c: F.concat(F.lit(f'<link rel="{rel}" href="'), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"/>'))
        entry = F.concat(
            F.lit('<entry xmlns="http://www.w3.org/2005/Atom"><title type="html">'), esc(F.col("title")), F.lit("</title>"),
            F.when(link != "", F.concat(href("self", F.lit("https://feeds.example.com/all")), href("alternate", link))).otherwise(""),
            F.when(d % 2 == 0, tag("summary", esc(F.col("description")))).otherwise(tag("content", esc(F.col("description")))),
            tag("published", date), tag("updated", zoned), F.lit("</entry>"),
        )
        item = F.concat(
            F.lit("<item>"), tag("title", esc(F.col("title"))), tag("link", link),
            tag("description", esc(F.col("description"))), tag("pubDate", date), tag("updated", zoned), F.lit("</item>"),
        )
        return self.spread_articles.select(
            "article_id", F.col("source_name").alias("source_id"), F.when(d % 7 == 3, entry).otherwise(item).alias("xml")
        )

    @cached_property
    def pages(self) -> DataFrame:
        """Pages with preview tags in several shapes added to their head."""
        p = F.col("page_id")
        title = F.translate(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "\"'", "")
        other = F.concat(F.lit("About "), title)
        head = F.concat(
            F.when(p % 5 == 0, F.lit("<meta property=\"og:title\" content=\"  \">")).otherwise(""),
            F.when(p % 7 == 3, F.lit("<meta property=\"og:title\" content=\"习惯高油价\">"))
            .when(p % 2 == 0, F.concat(F.lit("<meta property=\"og:title\" content=\""), title, F.lit("\">")))
            .otherwise(F.concat(F.lit("<META content='"), title, F.lit("' NAME='Twitter:Title'/>"))),
            F.when(p % 4 != 1, F.concat(F.lit("<meta name=\"og:description\"\n content=\"&lt;b&gt;"), other, F.lit("&lt;/b&gt;\">"))).otherwise(""),
            F.when(p % 3 == 0, F.concat(F.lit("<meta property=\"og:image\" content=\"https://img.example.com/"), p.cast("string"), F.lit(".jpg\">"))).otherwise(""),
            F.when(p % 3 == 1, F.concat(
                F.lit("<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"article\":{\"image\":\"https://next.example.com/"),
                p.cast("string"), F.lit("\"}}}}</script>"))).otherwise(""),
            F.lit("<img src=\"data:image/png;base64,xx\"><img class=\"a\" src=\"https://cdn.example.com/Favicon.png\">"),
            F.concat(F.lit("<img src=\"https://cdn.example.com/p/"), p.cast("string"), F.lit(".png\">")),
        )
        return self.texts_of("pages").select(
            "page_id", "url", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head)).alias("html")
        )
