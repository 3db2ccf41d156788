"""De-duplication, ingestion statistics, and choice of the work still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.text import is_blank, present


def _told_apart(items: DataFrame, key: str) -> DataFrame:
    """Adds ``_own``: the key, or a value of the row's own where it has none, so that keyless rows never meet in one task."""
    own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    return items.withColumn("_own", F.when(present(F.col(key)), F.col(key)).otherwise(own))


def dedupe_against_store(items: DataFrame, store: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Drop items whose (owner, key) is stored already.

    An empty key is never a duplicate, and owners do not see each other's
    documents.  The items are read once.
    """
    known = store.select(F.col("user_id").alias("_u"), F.col("source_path").alias("_k")).where("_k <> ''")
    same = F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("_own") == F.col("_k")) & present(F.col(key))
    return _told_apart(items, key).join(known, same, "left_anti").drop("_own")


def dedupe_within_batch(items: DataFrame, key: str = "dedupe_key", order: str = "pos") -> DataFrame:
    """Keep the first item of each (owner, key); keyless items all stay.

    The rank is bounded by one, so each input partition keeps one candidate per
    key before the shuffle: a key with a third of the rows costs one row per
    partition.  The items are read once.
    """
    first = F.row_number().over(Window.partitionBy("user_id", present(F.col(key)), "_own").orderBy(order))
    return _told_apart(items, key).withColumn("_first", first).where("_first = 1").drop("_first", "_own")


def new_items(items: DataFrame, store: DataFrame, within_batch: bool = True, key: str = "dedupe_key", order: str = "pos") -> DataFrame:
    once = dedupe_within_batch(items, key, order) if within_batch else items
    return dedupe_against_store(once, store, key)


def ingest_stats(normalized: DataFrame, store: DataFrame, key: str = "dedupe_key", order: str = "pos", within_batch: bool = True) -> DataFrame:
    """Fetched, new, duplicate and failed items per event.

    Works on keys alone: rows collapse to one per (owner, key, event) before
    anything is joined.  A key seen in several events is new in the first;
    without ``within_batch`` every item whose key is not stored is new.
    """
    good = normalized.where("error IS NULL")
    keys = good.where(present(F.col(key))).groupBy("user_id", key, "event_id").agg(F.min(order).alias("_at"), F.count(F.lit(1)).alias("_items"))
    if within_batch:
        rank = F.row_number().over(Window.partitionBy("user_id", key).orderBy("_at", "event_id"))
        keys = keys.withColumn("_rank", rank).where("_rank = 1").drop("_rank").withColumn("_items", F.lit(1))
    fresh = dedupe_against_store(keys, store, key).groupBy("event_id").agg(F.sum("_items").alias("_keyed"))
    totals = normalized.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("total_fetched"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").isNull() & ~present(F.col(key))).alias("_keyless"),
    )
    new = F.col("_keyless") + F.coalesce("_keyed", F.lit(0))
    out = totals.join(fresh, "event_id", "left").withColumn("new_documents", new)
    return out.select(
        "event_id", "total_fetched", "new_documents",
        (F.col("total_fetched") - F.col("errors") - F.col("new_documents")).alias("duplicates"), "errors",
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Current row per event out of an append-only log of status changes."""
    rest = [c for c in log.columns if c != "event_id"]
    row = F.struct(*[F.col(c) for c in rest])
    # status breaks ties of the same instant, so that the pick is repeatable
    last = log.groupBy("event_id").agg(F.max_by(row, F.struct("updated_at", "status")).alias("r"))
    return last.select("event_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Keyed upsert where the latest of several changes wins."""
    values = [c for c in current.columns if c not in keys]
    tagged = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*current.columns).withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(v) for v in values])
    picked = tagged.groupBy(*keys).agg(F.max_by(row, F.struct("_new", order)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{v}").alias(v) for v in values])


def due_subscriptions(users: DataFrame, preferences: DataFrame, as_of: str) -> DataFrame:
    """One pending event per user and stored subscription."""
    who = users.select(F.col("id").alias("user_id"))
    return preferences.join(who, "user_id", "left_semi").select(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "source", F.lit(as_of))).alias("id"),
        "user_id", "source", "source_params", F.lit("pending").alias("status"), F.to_timestamp(F.lit(as_of)).alias("started_at"),
    )


def due_totals(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Users served, users skipped for want of a subscription, events created."""
    per_user = preferences.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("_n").isNull()).alias("skipped_users"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events_created"),
    )


def pending_embedding_docs(documents: DataFrame, embeddings: DataFrame, model_name: str = "default") -> DataFrame:
    """Documents with text and without a vector of this model."""
    done = embeddings.where(F.col("model_name") == model_name).select(F.col("document_id").alias("id"))
    return documents.where(~is_blank(F.col("raw_text"))).join(done, "id", "left_anti")


def pending_sentiment_docs(documents: DataFrame, sentiments: DataFrame) -> DataFrame:
    done = sentiments.select(F.col("document_id").alias("id"))
    return documents.where(~is_blank(F.col("raw_text"))).join(done, "id", "left_anti")


def mark_processed(documents: DataFrame, embeddings: DataFrame, sentiments: DataFrame, now: Column, model_name: str = "default") -> DataFrame:
    """Processed once both a vector of the model and a sentiment exist."""
    vectors = embeddings.where(F.col("model_name") == model_name).select("document_id")
    both = vectors.join(sentiments.select("document_id"), "document_id", "left_semi").distinct()
    flagged = documents.drop("processed", "processed_at").join(
        both.select(F.col("document_id").alias("id"), F.lit(True).alias("_done")), "id", "left"
    )
    done = F.coalesce("_done", F.lit(False))
    return flagged.withColumn("processed", done).withColumn("processed_at", F.when(done, now)).drop("_done")
