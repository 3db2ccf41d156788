"""Assignment to existing clusters, cluster statistics, run summary.

Rows are ``(user_id, document_id, embedding)`` unless stated; the density
clustering itself lives in :mod:`trendloom.operators.density`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import vectors as V
from trendloom.operators.neighbours import BLOCK_ROWS, PIVOT_LISTS, nearest
from trendloom.runtime import require

SIMILARITY_THRESHOLD = 0.85
RECENT_DAYS = 7


def valid_vectors(rows: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Only vectors of the right width (a missing vector has none)."""
    return rows.where(F.coalesce(F.size(vec) == dim, F.lit(False)))


def unclustered_embeddings(
    embeddings: DataFrame, documents: DataFrame, members: DataFrame, model_name: str = "default",
    user_id=None, as_of: str | None = None, recent_days: int | None = None,
) -> DataFrame:
    """Embeddings of one model whose document is in no cluster yet.

    With ``recent_days`` only documents created that many days before ``as_of``
    or later; documents without owner take no part.
    """
    docs = documents.where("user_id IS NOT NULL")
    if user_id is not None:
        docs = docs.where(F.col("user_id") == user_id)
    if recent_days is not None:
        require(as_of is not None, "recent_days needs as_of")
        docs = docs.where(F.col("created_at") >= F.date_sub(F.to_date(F.lit(as_of)), recent_days).cast("timestamp"))
    docs = docs.select(F.col("id").alias("document_id"), "user_id", "created_at")
    mine = embeddings.where(F.col("model_name") == model_name)
    return mine.join(docs, "document_id").join(members.select("document_id"), "document_id", "left_anti")


def assign_to_existing(
    rows: DataFrame, clusters: DataFrame, dim: int, threshold: float = SIMILARITY_THRESHOLD,
    block_rows: int = BLOCK_ROWS, lists: int = PIVOT_LISTS,
) -> DataFrame:
    """Nearest centroid of the same owner when at least ``threshold`` similar.

    Centroids are a snapshot, so the result does not depend on row order; ties
    go to the smallest cluster id.
    """
    best = nearest(
        valid_vectors(rows, dim), valid_vectors(clusters, dim, "centroid"), 1, query_key="document_id",
        corpus_key="id", corpus_vec="centroid", group="user_id", block_rows=block_rows, lists=lists,
    )
    scored = best.select(
        F.col("grp").alias("user_id"), F.col("query_id").alias("document_id"),
        F.col("neighbour_id").alias("cluster_id"), (F.lit(1.0) - F.col("distance")).alias("membership_strength"),
    )
    return scored.where(F.col("membership_strength") >= threshold)


def update_centroids(clusters: DataFrame, assigned: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Running mean over newly assigned members: ``(c * n + sum(v)) / (n + m)``."""
    vectors = assigned.select("cluster_id", "document_id").join(embeddings.select("document_id", "embedding"), "document_id")
    added = V.sum_by(vectors, ["cluster_id"], "embedding", dim, "_added", F.count(F.lit(1)).alias("_m"))
    joined = clusters.join(added.withColumnRenamed("cluster_id", "id"), "id", "left")
    total = F.col("document_count") + F.col("_m")
    moved = F.zip_with("centroid", "_added", lambda c, s: (c * F.col("document_count") + s) / total)
    return joined.select(
        *[c for c in clusters.columns if c not in ("centroid", "document_count")],
        F.coalesce(moved, "centroid").alias("centroid"),
        F.coalesce(total, "document_count").alias("document_count"),
    )


def drop_noise(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.where(F.col(label).cast("string") != "-1")


def cluster_centroids(rows: DataFrame, dim: int, keys: list[str] | None = None) -> DataFrame:
    """Plain mean vector and size per cluster (not scaled to unit length)."""
    return V.mean_by(rows, keys or ["cluster_id"], "embedding", dim, "centroid")


def cluster_avg_sentiment(members: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Mean combined score of the members; ``NULL`` when none is scored."""
    scores = sentiments.select("document_id", "combined_score")
    return members.join(scores, "document_id", "left").groupBy("cluster_id").agg(F.avg("combined_score").alias("avg_sentiment"))


def membership_strength(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Cosine similarity of each member to its cluster's centroid.

    The centroid's norm is computed once per cluster; the join key is the
    cluster, which adaptive execution may split when one cluster is hot.
    """
    scaled = centroids.select("cluster_id", V.unit(F.col("centroid")).alias("_c"))
    strength = F.try_divide(V.dot(F.col("_c"), F.col("embedding")), V.norm(F.col("embedding")))
    return rows.join(scaled, "cluster_id").withColumn("membership_strength", strength).drop("_c")


def new_clusters(labelled: DataFrame, sentiments: DataFrame, dim: int) -> DataFrame:
    """One row per found cluster of ``(user_id, cluster_id, document_id, embedding)``."""
    centroids = cluster_centroids(labelled, dim, ["user_id", "cluster_id"])
    mood = cluster_avg_sentiment(labelled.select("cluster_id", "document_id"), sentiments)
    return centroids.join(mood, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"), "user_id", "centroid", "document_count", "avg_sentiment",
        F.lit(None).cast("double").alias("trending_score"),
    )


def run_summary(processed: DataFrame, clusters: DataFrame, new_members: DataFrame, assigned: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row of totals for a clustering run."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))

    out = counted(processed, "embeddings_processed")
    for df, name in (
        (clusters, "clusters_created"), (new_members, "members_created"),
        (assigned, "members_assigned_to_existing"), (keywords, "keywords_created"),
    ):
        out = out.join(counted(df, name), "_one")
    status = F.when(F.col("embeddings_processed") == 0, "skipped").otherwise("completed")
    return out.drop("_one").withColumn("status", status)
