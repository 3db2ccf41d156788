"""Clusters ranked by trending score: centroids, members, series, anomalies, score, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import AS_OF, Spark
from trendloom.operators import anomaly, timeseries, trending


def ranked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Spark(spark, sf_dir)
    clusters = v.clusters()
    daily = timeseries.daily_aggregates(v.members(), v.documents(), v.sentiments())
    series = timeseries.add_momentum(daily)
    scores = trending.trending_scores(clusters, series, anomaly.detect_anomalies(series), AS_OF)
    ranked = trending.update_trending(clusters, scores)
    shown = ranked.select("id", "user_id", "name", "document_count", "avg_sentiment", "trending_score")
    return shown.orderBy(F.desc_nulls_last("trending_score"), "id")
