"""Sources: registry, landed feed files and items as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import blank_to_null, published_utc, strip
from newsflow.functions.urls import url_hash

ITEM = "title string, link string, description string, pubDate string, updated string"
#: An item of the other kind of feed: addresses are attributes of its links, the text is a summary or the content.
ENTRY = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string"
#: Where an unreadable file or item ends up whole.
BROKEN = "broken"
REGISTRY = "source_id string, name string, feed_url string, domain string, in_use boolean"


def source_registry(registry: DataFrame) -> DataFrame:
    """Sources in use that have a feed; the feed address stands in for a blank name."""
    return registry.filter(F.col("in_use") & (F.coalesce("feed_url", F.lit("")) != "")).withColumn(
        "name", F.coalesce(blank_to_null(F.col("name")), F.col("feed_url"))
    )


def _of_item(dates: bool = False) -> list[Column]:
    published = F.coalesce("pubDate", "`dc:date`") if dates else F.col("pubDate")
    return [F.col("title"), F.col("link"), F.col("description"), published.alias("pubDate"), F.col("updated")]


def _of_entry(get: Callable[[str], Column]) -> list[Column]:
    """An entry as an item: its first link that leads to the page itself, else its first link."""
    links = F.filter(get("link"), lambda x: x["_href"].isNotNull())
    pages = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return [
        get("title").alias("title"), F.coalesce(F.get(pages, F.lit(0)), F.get(links, F.lit(0)))["_href"].alias("link"),
        F.coalesce(get("summary"), get("content")).alias("description"), get("published").alias("pubDate"), get("updated").alias("updated"),
    ]


def read_feed_files(spark: SparkSession, path: str, kind: str = "xml", streaming: bool = False) -> DataFrame:
    """Landed feed files as items, one folder per source below `path` (`source_id=...`).

    XML files may hold items or entries, whatever the file is called. A file that cannot be read is one row with its
    content in the column `broken` and nothing else; `malformed` lists those, `feed_scan` passes over them.
    """
    reader = spark.readStream if streaming else spark.read
    if kind != "xml":
        return reader.format("json").schema(f"{ITEM}, source_id string").load(path).withColumn(BROKEN, F.lit(None).cast("string"))

    def rows(tag: str, schema: str) -> DataFrame:
        # Read anew for each kind of tag: a file has one of them, and the other finds nothing in it.
        made = reader.format("xml").option("rowTag", tag).option("columnNameOfCorruptRecord", BROKEN)
        return made.schema(f"{schema}, {BROKEN} string, source_id string").load(path)

    items = rows("item", f"{ITEM}, `dc:date` string").select(*_of_item(dates=True), "source_id", BROKEN)
    # An unreadable file is unreadable to both readers; the first one reports it.
    entries = rows("entry", ENTRY).filter(F.col(BROKEN).isNull()).select(*_of_entry(F.col), "source_id", BROKEN)
    return items.unionByName(entries)


def malformed(items: DataFrame) -> DataFrame:
    """The unreadable files or items, for a table beside the articles."""
    # The readers refuse a query on this column alone; an unreadable row has no title.
    return items.filter(F.col(BROKEN).isNotNull() & F.col("title").isNull()).select(*[c for c in items.columns if c not in ("title", "link", "description", "pubDate", "updated")])


def parse_items(items: DataFrame, column: str = "xml") -> DataFrame:
    """Items or entries that arrive as XML text in a column; the text of an unreadable one goes to `broken`."""
    others = [c for c in items.columns if c != column]
    how = {"columnNameOfCorruptRecord": BROKEN}
    rows = items.select(
        *others, F.from_xml(column, f"{ITEM}, {BROKEN} string", {"rowTag": "item", **how}).alias("item"),
        F.from_xml(column, f"{ENTRY}, {BROKEN} string", {"rowTag": "entry", **how}).alias("entry"),
        F.col(column).rlike(r"^\s*(<\?[^>]*>\s*)?<(\w+:)?entry\b").alias("is_entry"),
    )
    entry = F.struct(*_of_entry(lambda c: F.col(f"entry.{c}")), F.col(f"entry.{BROKEN}").alias(BROKEN))
    item = F.struct(*[F.col(f"item.{c}").alias(c) for c in ("title", "link", "description", "pubDate", "updated", BROKEN)])
    return rows.select(*others, F.when(F.col("is_entry"), entry).otherwise(item).alias("found")).select(*others, "found.*")


def feed_scan(items: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """One article per item with a link, with the name of its source. Sources are a short list."""
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    rows = items.filter(text("link") != "").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    extra = [c for c in items.columns if c not in ("title", "link", "description", "pubDate", "updated", "source_id", BROKEN)]
    return rows.select(
        *extra,
        text("link").alias("url"),
        url_hash(text("link")).alias("url_hash"),
        "source_name",
        text("title").alias("title"),
        text("description").alias("description"),
        published_utc(F.col("pubDate"), F.col("updated"), as_of).alias("published_at"),
    )
