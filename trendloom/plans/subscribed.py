"""Ingestion driven by subscriptions: each landed target is read and normalised once and dealt to all who want it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.subscriptions import requests
from trendloom.plans.ingest import CONTENT, Ingested, ingest_items, item_columns
from trendloom.runtime import cut_lineage, require, spread
from trendloom.sources.landed import feed_entry_fields, union_sources, valid_stories
from trendloom.sources.normalize import NORMALIZERS

#: The switch that leaves a kind of item out, and the request column that names the wanted state.
SWITCHES = {"commit": "include_commits", "issue": "include_issues", "pr": "include_prs", "release": "include_releases"}
STATES = {"issue": "issue_state", "pr": "pr_state"}
SOURCE_OF = {"feed": "rss", "story": "hackernews", "commit": "github", "issue": "github", "pr": "github", "release": "github"}
#: A target's items are few, its subscribers may be a third of all: they are dealt to so many keys.
SALTS = 16
_SAME = ("_target", "_state", "_since")


def wanted_of(wanted: DataFrame, kind: str) -> DataFrame:
    """Who wants what of one kind: ``user_id, event_id, _target, _state, _since, _limit``; no state or since means all."""
    rows = wanted.where(F.col("source") == SOURCE_OF[kind])
    if kind in SWITCHES:
        rows = rows.where(SWITCHES[kind])
    state = F.nullif(F.col(STATES[kind]), F.lit("all")) if kind in STATES else F.lit(None).cast("string")
    since = F.nullif(F.col("commit_since"), F.lit("")) if kind == "commit" else F.lit(None).cast("string")
    return rows.select("user_id", "event_id", F.col("target").alias("_target"), state.alias("_state"), since.alias("_since"), F.col("item_limit").alias("_limit"))


def _target(kind: str) -> Column:
    if kind == "feed":
        return F.col("feed_url")
    return F.lower("endpoint") if kind == "story" else F.concat("owner", F.lit("/"), "repo")


def _first_items(raw: DataFrame, kind: str, variants: DataFrame, most: int) -> DataFrame:
    """Items of each wanted (target, state, since) up to the largest limit anyone has, with their ``_rank`` there.

    The bound on the rank lets Spark cut each input partition before the
    shuffle, so a hot target does not travel whole.  State and date are filtered before the rank, pull
    requests among issues, too.
    """
    if kind == "issue":
        raw = raw.where("pull_request IS NULL")
    of = raw.withColumn("_at", _target(kind)).join(variants.withColumnRenamed("_target", "_at"), "_at").withColumnRenamed("_at", "_target")
    if kind in STATES:
        of = of.where(F.col("_state").isNull() | (F.col("state") == F.col("_state")))
    if kind == "commit":
        of = of.where(F.col("_since").isNull() | (F.col("commit.author.date") >= F.col("_since")))
    rank = F.row_number().over(Window.partitionBy(*_SAME).orderBy("pos"))
    return of.withColumn("_rank", rank).where(F.col("_rank") <= most).where(F.col("_rank") <= F.col("_most")).drop("_most")


def _first_stories(lists: DataFrame, items: DataFrame, variants: DataFrame, most: int) -> DataFrame:
    """Valid stories of the wanted endpoints; the place in the list counts, whether the items before it are valid or not."""
    at = lists.withColumn("_target", _target("story")).join(variants, "_target")
    ranked = at.select("endpoint", *_SAME, "_most", F.posexplode(F.slice("ids", 1, most)).alias("pos", "id")).where("id IS NOT NULL AND pos < _most")
    return valid_stories(ranked.join(items, "id")).withColumn("_rank", F.col("pos") + 1).drop("_most")


def subscribed_items(landed: dict[str, DataFrame], wanted: DataFrame, archive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Normalised items of all kinds, one row per item and subscriber that gets it, and the contents of the items.

    The items name their content by ``item_type, item_ref``; titles, texts and payloads stay in the
    contents, one row per normalised item, and are not copied for each subscriber.

    ``landed`` maps a kind to its landed rows (``story_ids`` and ``story``
    belong together).  Limits, states, switches and dates come from ``wanted``, the rows of
    :func:`trendloom.operators.subscriptions.requests` with an ``event_id``.  An item is normalised once for
    each (state, date) it is wanted under, however many users want it.  ``archive`` keeps the landed
    payload as JSON.
    """
    unknown = set(landed) - set(NORMALIZERS) - {"story_ids"}
    require(not unknown, f"unknown item types: {sorted(unknown)}")
    require(("story" in landed) == ("story_ids" in landed), "stories need their lists and items")
    wanted = cut_lineage(wanted, "requests")
    parts: dict[str, DataFrame] = {}
    contents: dict[str, DataFrame] = {}
    for kind in (k for k in NORMALIZERS if k in landed):
        mine = wanted_of(wanted, kind)
        most = mine.agg(F.max("_limit")).first()[0]
        if most is None:
            continue
        variants = mine.groupBy(*_SAME).agg(F.max("_limit").alias("_most"))
        if kind == "story":
            chosen = _first_stories(landed["story_ids"], landed["story"], variants, most)
        else:
            chosen = _first_items(landed[kind], kind, variants, most)
        own = [c for c in chosen.columns if not c.startswith("_")]
        if archive:
            chosen = chosen.withColumn("payload", F.to_json(F.struct(*own)))
        if kind == "feed":
            kept = [*_SAME, "_rank", *(["payload"] if archive else [])]
            chosen = feed_entry_fields(chosen, kept)
        normal = item_columns(NORMALIZERS[kind](chosen), kind, [*_SAME, "_rank", *(["payload"] if archive else [])])
        # written, so that the number of an item is the same in both results
        normal = cut_lineage(normal.withColumn("item_ref", F.monotonically_increasing_id()), f"{kind}-items")
        whole = [c for c in CONTENT if c in normal.columns]
        contents[kind] = normal.select("item_ref", *whole)
        normal = normal.drop(*whole)
        dealt = normal.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("i")
        salted = mine.withColumn("_salt", F.pmod(F.xxhash64("user_id", "event_id"), F.lit(SALTS)).cast("int")).alias("w")
        same = (F.col("i._target") == F.col("w._target")) & (F.col("i._salt") == F.col("w._salt")) & (F.col("i._rank") <= F.col("w._limit"))
        for c in ("_state", "_since"):
            same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"w.{c}"))
        columns = [F.col(f"i.{c}").alias(c) for c in normal.columns if not c.startswith("_")]
        parts[kind] = dealt.join(salted, same).select("w.user_id", "w.event_id", *columns)
    require(bool(parts), "no valid subscription to any landed kind of item")
    return union_sources(parts), union_sources(contents)


def ingest_subscribed(events: DataFrame, landed: dict[str, DataFrame], store: DataFrame, created_at: Column, *, within_batch: bool = True, archive: bool = False) -> Ingested:
    """One batch for all due events: ``id, user_id, source, source_params`` as :func:`due_subscriptions` makes them.

    Refused subscriptions take no part.  Documents, statistics and failures come per event.
    """
    # parameters are costly to read, and a table of many subscriptions may be one small file
    wanted = requests(spread(events.withColumnRenamed("id", "event_id"), "event_id"), keep=("event_id",))
    items, contents = subscribed_items(landed, wanted, archive)
    return ingest_items(items, store, created_at, within_batch, contents)
