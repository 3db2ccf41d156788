"""Scans of landed raw items (JSON lines), with each source's own limits.

The per-feed and per-repository caps are features of the sources.  They are
window ranks with an upper bound, so Spark ranks each partition first and a hot
feed never travels whole to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.runtime import require

DEFAULT_LIMIT = 50
STATES = ("all", "open", "closed")


def scan_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines under a fixed schema; lines that are no object are dropped."""
    return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)


def first_per(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``."""
    require(limit >= 1, "limit must be positive")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def feed_entry_fields(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Landed feed entries in the shape the normaliser reads, with the columns to ``keep``."""

    def text(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    tags = F.transform(F.coalesce("tags", F.array()), lambda t: F.coalesce(t["term"], F.lit("")))
    return raw.select(
        "feed_url",
        "pos",
        F.coalesce("id", "link", F.lit("")).alias("id"),
        text("title").alias("title"),
        text("link").alias("link"),
        text("summary").alias("summary"),
        F.coalesce(F.try_element_at("content", F.lit(1))["value"], F.lit("")).alias("content"),
        text("published").alias("published"),
        text("author").alias("author"),
        tags.alias("tags"),
        *keep,
    )


def scan_feed_entries(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``limit`` entries of each feed; a missing id falls back to the link."""
    raw = scan_json(spark, path, schemas.FEED_ENTRY)
    return feed_entry_fields(first_per(raw, ["feed_url"], "pos", limit))


def scan_feed_xml(spark: SparkSession, path: str, feed_url: str | Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``limit`` entries of landed feed XML documents, one file a feed, in document order.

    ``path`` may name many files; ``feed_url`` is then a column over ``path``
    (the file) and ``channel_link``.  A feed document is read whole and parsed
    once, so an entry's ``pos`` is its place in its document whatever the
    splits.  Files without a channel or entries give no rows.  Each file costs
    a listing and an opening; many feeds are better landed as rows of few
    files, for :func:`feed_xml_entries`.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return feed_xml_entries(files, feed_url, limit)


def feed_xml_entries(documents: DataFrame, feed_url: str | Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``limit`` entries of feed XML documents, one document a row: its ``path`` and whole text ``value``."""
    item = (
        "STRUCT<guid: STRING, title: STRING, link: STRING, description: STRING, `content:encoded`: STRING, "
        "pubDate: STRING, author: STRING, category: ARRAY<STRING>>"
    )
    parsed = documents.select("path", F.from_xml("value", f"channel STRUCT<link: STRING, item: ARRAY<{item}>>").alias("d"))
    items = parsed.select("path", F.col("d.channel.link").alias("channel_link"), F.posexplode(F.slice("d.channel.item", 1, limit)).alias("pos", "e"))
    e = F.col("e")
    content = e["content:encoded"]
    raw = items.select(
        (F.lit(feed_url) if isinstance(feed_url, str) else feed_url).alias("feed_url"),
        F.col("pos").cast("bigint").alias("pos"),
        e["guid"].alias("id"),
        e["title"].alias("title"),
        e["link"].alias("link"),
        e["description"].alias("summary"),
        F.when(content.isNotNull(), F.array(F.struct(content.alias("value")))).alias("content"),
        e["pubDate"].alias("published"),
        e["author"].alias("author"),
        F.transform(e["category"], lambda c: F.struct(c.alias("term"))).alias("tags"),
    )
    return feed_entry_fields(raw)


def scan_story_ids(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Ranked ids of each endpoint list, the first ``limit`` of each."""
    require(1 <= limit <= 500, "story limit must be 1..500")
    lists = scan_json(spark, path, schemas.STORY_IDS)
    ranked = lists.select("endpoint", F.posexplode(F.slice("ids", 1, limit)).alias("pos", "id"))
    return ranked.where(F.col("id").isNotNull())


def scan_items(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Landed items for the wanted ids; ids without an item are dropped."""
    return ids.join(scan_json(spark, path, schemas.STORY_ITEM), "id")


def valid_stories(items: DataFrame) -> DataFrame:
    """Stories only, neither deleted nor dead.

    The id limit was applied before, so fewer than ``limit`` may come out.
    """
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    return items.where((F.col("type") == "story") & ~gone)


def scan_commits(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT, since: str | None = None) -> DataFrame:
    """Commits per repository, optionally dated ``since`` or later (ISO text)."""
    rows = scan_json(spark, path, schemas.COMMIT)
    if since is not None:
        rows = rows.where(F.col("commit.author.date") >= since)
    return first_per(rows, ["owner", "repo"], "pos", limit)


def _in_state(rows: DataFrame, state: str) -> DataFrame:
    require(state in STATES, f"state must be one of {STATES}")
    return rows if state == "all" else rows.where(F.col("state") == state)


def scan_issues(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT, state: str = "all") -> DataFrame:
    """Issues per repository without those that are pull requests; capped after the filter."""
    rows = scan_json(spark, path, schemas.ISSUE).where("pull_request IS NULL")
    return first_per(_in_state(rows, state), ["owner", "repo"], "pos", limit)


def scan_pull_requests(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT, state: str = "all") -> DataFrame:
    rows = scan_json(spark, path, schemas.PULL_REQUEST)
    return first_per(_in_state(rows, state), ["owner", "repo"], "pos", limit)


def scan_releases(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return first_per(scan_json(spark, path, schemas.RELEASE), ["owner", "repo"], "pos", limit)


def union_sources(parts: dict[str, DataFrame], include: dict[str, bool] | None = None) -> DataFrame:
    """Concatenate normalised items of several kinds, tagged with ``item_type``.

    ``include`` switches kinds off; kinds not named are kept.
    """
    wanted = {k: df for k, df in parts.items() if (include or {}).get(k, True)}
    require(bool(wanted), "at least one item type must be included")
    tagged = [df.withColumn("item_type", F.lit(k)) for k, df in wanted.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
