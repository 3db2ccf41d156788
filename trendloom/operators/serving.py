"""Filtered, sorted and paginated views of the tables.

List queries return a :class:`Page`: the rows of the page and a one-row frame
with the total before pagination.  The key always ends the sort order, so pages
never overlap.  Sorting with offset and limit is planned as a top-k.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.runtime import require

MAX_LIMIT = 10_000
DOCUMENT_COLUMNS = (
    "id", "user_id", "ingest_event_id", "source_path", "title", "processed", "processed_at", "created_at", "updated_at"
)
CLUSTER_COLUMNS = ("id", "user_id", "name", "document_count", "avg_sentiment", "trending_score", "created_at", "updated_at")
KEYWORD_COLUMNS = ("id", "keyword", "weight", "created_at")
SERIES_COLUMNS = ("id", "summary_date", "mention_count", "avg_sentiment", "momentum", "forecast_lower", "forecast_upper", "created_at")
INSIGHT_COLUMNS = ("id", "insight_text", "confidence", "generated_at", "llm_metadata")
ANOMALY_COLUMNS = ("id", "anomaly_date", "score", "type", "anomaly_metadata", "created_at")
EVENT_STATES = ("pending", "processing", "completed", "failed")


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame


def paginate_with_total(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> Page:
    require(1 <= limit <= MAX_LIMIT, f"limit must be 1..{MAX_LIMIT}")
    require(offset >= 0, "offset must not be negative")
    return Page(rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total")))


def _shown(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The public columns; a table without one of them is refused."""
    missing = [c for c in columns if c not in df.columns]
    require(not missing, f"columns are missing: {missing}")
    return df.select(*columns)


def owned(rows: DataFrame, clusters: DataFrame, user_id) -> DataFrame:
    """Rows keyed by ``cluster_id`` whose cluster belongs to the owner."""
    mine = clusters.where(F.col("user_id") == user_id).select(F.col("id").alias("cluster_id"))
    return rows.join(mine, "cluster_id", "left_semi")


def list_documents(
    documents: DataFrame, user_id, *, processed: bool | None = None, ingest_event_id=None, cluster_id=None, source: str | None = None,
    min_sentiment: float | None = None, max_sentiment: float | None = None, members: DataFrame | None = None,
    events: DataFrame | None = None, sentiments: DataFrame | None = None, limit: int = 100, offset: int = 0,
) -> Page:
    """An owner's documents, newest first.

    Sentiment bounds are inclusive and drop documents without a score.  Every
    filter table is reduced to its keys and joined as a semi join, so no row is
    multiplied and no distinct is needed.
    """
    for bound in (min_sentiment, max_sentiment):
        require(bound is None or -1 <= bound <= 1, "sentiment bounds must be in -1..1")
    if min_sentiment is not None and max_sentiment is not None:
        require(min_sentiment <= max_sentiment, "min_sentiment must not exceed max_sentiment")
    rows = documents.where(F.col("user_id") == user_id)
    if processed is not None:
        rows = rows.where(F.col("processed") == processed)
    if ingest_event_id is not None:
        rows = rows.where(F.col("ingest_event_id") == ingest_event_id)
    if cluster_id is not None:
        inside = members.where(F.col("cluster_id") == cluster_id).select(F.col("document_id").alias("id"))
        rows = rows.join(inside, "id", "left_semi")
    if source is not None:
        wanted = events.where(F.lower("source") == source.lower()).select(F.col("id").alias("ingest_event_id"))
        rows = rows.join(wanted, "ingest_event_id", "left_semi")
    if min_sentiment is not None or max_sentiment is not None:
        scored = sentiments.where("combined_score IS NOT NULL")
        if min_sentiment is not None:
            scored = scored.where(F.col("combined_score") >= min_sentiment)
        if max_sentiment is not None:
            scored = scored.where(F.col("combined_score") <= max_sentiment)
        rows = rows.join(scored.select(F.col("document_id").alias("id")), "id", "left_semi")
    return paginate_with_total(_shown(rows, DOCUMENT_COLUMNS), [F.desc("created_at"), F.asc("id")], limit, offset)


def document_detail(documents: DataFrame, sentiments: DataFrame, members: DataFrame, user_id, document_id) -> DataFrame:
    """One document with its sentiment and cluster memberships."""
    one = documents.where((F.col("id") == document_id) & (F.col("user_id") == user_id))
    mood = sentiments.where(F.col("document_id") == document_id).select(
        F.col("document_id").alias("id"), F.struct("vader", "distilbert_score", "distilbert_label", "combined_score").alias("sentiment")
    )
    inside = members.where(F.col("document_id") == document_id).groupBy(F.col("document_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("cluster_id", "membership_strength"))).alias("memberships")
    )
    return one.join(mood.dropDuplicates(["id"]), "id", "left").join(inside, "id", "left")


def list_clusters(clusters: DataFrame, user_id, limit: int = 100, offset: int = 0) -> Page:
    """An owner's clusters, the most trending first, unscored last."""
    rows = _shown(clusters.where(F.col("user_id") == user_id), CLUSTER_COLUMNS)
    return paginate_with_total(rows, [F.desc_nulls_last("trending_score"), F.asc("id")], limit, offset)


class ClusterDetail(NamedTuple):
    cluster: DataFrame
    keywords: DataFrame
    timeseries: DataFrame
    insights: DataFrame
    anomalies: DataFrame
    members: DataFrame


def cluster_detail(
    clusters: DataFrame, user_id, cluster_id, *, keywords: DataFrame, series: DataFrame, insights: DataFrame, anomalies: DataFrame,
    members: DataFrame, documents: DataFrame,
) -> ClusterDetail:
    """One owned cluster and the rows that hang on it.

    The parts stay separate frames keyed by ``cluster_id``: packing the members
    into one array would put a cluster of any size into one row.  All parts are
    empty when the cluster is not the owner's.
    """
    one = _shown(clusters.where((F.col("id") == cluster_id) & (F.col("user_id") == user_id)), CLUSTER_COLUMNS)

    def part(table: DataFrame, *columns: str) -> DataFrame:
        return _shown(owned(table.where(F.col("cluster_id") == cluster_id), clusters, user_id), ("cluster_id", *columns))

    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return ClusterDetail(
        one,
        part(keywords, *KEYWORD_COLUMNS),
        part(series, *SERIES_COLUMNS),
        part(insights, *INSIGHT_COLUMNS),
        part(anomalies, *ANOMALY_COLUMNS),
        part(members, "document_id", "membership_strength").join(titles, "document_id"),
    )


def list_insights(insights: DataFrame, clusters: DataFrame, user_id, cluster_id=None, limit: int = 100, offset: int = 0) -> Page:
    rows = _shown(owned(insights, clusters, user_id), ("cluster_id", *INSIGHT_COLUMNS))
    if cluster_id is not None:
        rows = rows.where(F.col("cluster_id") == cluster_id)
    return paginate_with_total(rows, [F.desc("generated_at"), F.asc("id")], limit, offset)


def insight_detail(insights: DataFrame, clusters: DataFrame, user_id, insight_id) -> DataFrame:
    return owned(insights.where(F.col("id") == insight_id), clusters, user_id)


def list_anomalies(
    anomalies: DataFrame, clusters: DataFrame, user_id, *, cluster_id=None, kind: str | None = None, start: str | None = None,
    end: str | None = None, limit: int = 100, offset: int = 0,
) -> Page:
    """An owner's anomalies, latest first, then those found last; the date range is inclusive."""
    rows = _shown(owned(anomalies, clusters, user_id), ("cluster_id", *ANOMALY_COLUMNS))
    if cluster_id is not None:
        rows = rows.where(F.col("cluster_id") == cluster_id)
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    if start is not None:
        rows = rows.where(F.col("anomaly_date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("anomaly_date") <= F.to_date(F.lit(end)))
    order = [F.desc("anomaly_date"), F.desc("created_at"), F.asc("cluster_id"), F.asc("type"), F.asc("id")]
    return paginate_with_total(rows, order, limit, offset)


def list_ingest_events(events: DataFrame, user_id, status: str | None = None, limit: int = 100, offset: int = 0) -> Page:
    require(status is None or status in EVENT_STATES, f"status must be one of {EVENT_STATES}")
    rows = events.where(F.col("user_id") == user_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return paginate_with_total(rows, [F.desc("started_at"), F.asc("id")], limit, offset)


def ingest_event_detail(events: DataFrame, user_id, event_id) -> DataFrame:
    return events.where((F.col("id") == event_id) & (F.col("user_id") == user_id))


PROJECTION_COLUMNS = ("document_id", "title", "source_path", "cluster_id", "x", "y")


def cluster_projections(members: DataFrame, clusters: DataFrame, documents: DataFrame, projections: DataFrame, user_id, cluster_id,
                        model_name: str = "default") -> DataFrame:
    """Members of an owned cluster with their place on the map."""
    mine = owned(members.where(F.col("cluster_id") == cluster_id), clusters, user_id)
    docs = documents.where(F.col("user_id") == user_id).select(F.col("id").alias("document_id"), "title", "source_path")
    places = projections.where(F.col("model_name") == model_name)
    return mine.join(docs, "document_id").join(places, "document_id").select(*PROJECTION_COLUMNS)


def primary_cluster(members: DataFrame) -> DataFrame:
    """One cluster per document: strongest membership, missing last, then smallest id."""
    order = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("membership_strength"), F.asc("cluster_id"))
    return members.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("document_id", "cluster_id")


def user_projections(documents: DataFrame, projections: DataFrame, members: DataFrame, user_id, limit: int = 1000, model_name: str = "default", offset: int = 0) -> DataFrame:
    """An owner's projected documents with their primary cluster, by document id; further ones from ``offset`` on."""
    require(1 <= limit <= MAX_LIMIT, f"limit must be 1..{MAX_LIMIT}")
    require(offset >= 0, "offset must not be negative")
    docs = documents.where(F.col("user_id") == user_id).select(F.col("id").alias("document_id"), "title", "source_path")
    places = projections.where(F.col("model_name") == model_name).select("document_id", "x", "y")
    shown = docs.join(places, "document_id").orderBy("document_id").offset(offset).limit(limit)
    theirs = members.join(shown.select("document_id"), "document_id", "left_semi")
    return shown.join(primary_cluster(theirs), "document_id", "left").select(*PROJECTION_COLUMNS)
