"""Daily series per cluster, momentum and forecast bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.runtime import require
from trendloom.sources.tables import replace_by_key

FORECAST_DAYS = 7
# Fixed value: half-width of an 80 % normal interval in standard deviations.
BAND_Z = 1.2815515655446004


def daily_aggregates(members: DataFrame, documents: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Mentions and mean sentiment per cluster and UTC day, all clusters at once.

    Only documents with a sentiment row count; the mean ignores missing scores.
    """
    docs = documents.select(F.col("id").alias("document_id"), F.to_date("created_at").alias("summary_date"))
    scores = sentiments.select("document_id", "combined_score")
    scored = members.select("cluster_id", "document_id").join(scores, "document_id").join(docs, "document_id")
    return scored.groupBy("cluster_id", "summary_date").agg(
        F.count(F.lit(1)).alias("mention_count"), F.avg("combined_score").alias("avg_sentiment")
    )


def add_momentum(daily: DataFrame) -> DataFrame:
    """Change of mean sentiment since the last earlier day that has one."""
    before = Window.partitionBy("cluster_id").orderBy("summary_date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("momentum", F.col("avg_sentiment") - F.last("avg_sentiment", ignorenulls=True).over(before))


def future_dates(daily: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """The days right after each cluster's last day; gaps inside stay gaps."""
    require(days >= 1, "forecast needs at least one day")
    last = daily.groupBy("cluster_id").agg(F.max("summary_date").alias("_last"))
    span = F.sequence(F.date_add("_last", 1), F.date_add("_last", days))
    return last.select("cluster_id", F.explode(span).alias("summary_date"))


def forecast_band(daily: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """Band of daily mentions for the history and the following days.

    Linear trend plus day-of-week effect, both in closed form, with an 80 % band
    from the spread of what is left.  Clusters with fewer than two days get no
    band.  One aggregate fits every cluster; nothing is looped.
    """
    start = daily.groupBy("cluster_id").agg(F.min("summary_date").alias("_start"))
    at = daily.join(start, "cluster_id").withColumn("_x", F.datediff("summary_date", "_start").cast("double"))
    fit = at.groupBy("cluster_id").agg(
        F.regr_slope("mention_count", "_x").alias("_slope"),
        F.regr_intercept("mention_count", "_x").alias("_base"),
        F.min("_start").alias("_start"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n >= 2")
    weekday = F.dayofweek("summary_date")
    trend = F.col("_base") + F.col("_slope") * F.datediff("summary_date", "_start")
    history = daily.join(fit, "cluster_id").withColumn("_resid", F.col("mention_count") - trend).withColumn("_dow", weekday)
    history = history.withColumn("_effect", F.avg("_resid").over(Window.partitionBy("cluster_id", "_dow")))
    effects = history.groupBy("cluster_id", "_dow").agg(F.first("_effect").alias("_effect"))
    spread = history.groupBy("cluster_id").agg(F.stddev_samp(F.col("_resid") - F.col("_effect")).alias("_sigma"))
    dates = daily.select("cluster_id", "summary_date").unionByName(future_dates(daily, days))
    placed = dates.join(fit.join(spread, "cluster_id"), "cluster_id").withColumn("_dow", weekday)
    centre = trend + F.coalesce("_effect", F.lit(0.0))
    return placed.join(effects, ["cluster_id", "_dow"], "left").select(
        "cluster_id", "summary_date",
        (centre - BAND_Z * F.col("_sigma")).alias("forecast_lower"),
        (centre + BAND_Z * F.col("_sigma")).alias("forecast_upper"),
    )


def merge_forecast(history: DataFrame, bands: DataFrame) -> DataFrame:
    """History with its band, and forecast days with no mentions, flagged."""
    both = history.withColumn("_seen", F.lit(True)).join(bands, ["cluster_id", "summary_date"], "full_outer")
    return both.select(
        "cluster_id", "summary_date", F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        "avg_sentiment", "momentum", "forecast_lower", "forecast_upper", F.col("_seen").isNull().alias("is_forecast"),
    )


def build_series(members: DataFrame, documents: DataFrame, sentiments: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    daily = daily_aggregates(members, documents, sentiments)
    return merge_forecast(add_momentum(daily), forecast_band(daily, days))


def replace_summaries(current: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of the processed clusters are replaced; doing it twice changes nothing."""
    return replace_by_key(current, fresh, ["cluster_id"], processed)


def observed_only(series: DataFrame, include_forecast_rows: bool = False) -> DataFrame:
    """What anomaly detection and trending look at.

    Forecast days carry no observation.  ``include_forecast_rows=True`` keeps
    them, as a table without the flag would.
    """
    if include_forecast_rows or "is_forecast" not in series.columns:
        return series
    return series.where(~F.col("is_forecast"))
