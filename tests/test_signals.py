"""Series, anomalies and trending on hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.functions.scores import combine_scores, confidence, sentiment_label
from trendloom.operators import anomaly, timeseries, trending

DDL = "cluster_id STRING, summary_date DATE, mention_count BIGINT, avg_sentiment DOUBLE, momentum DOUBLE"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def series(spark, rows):
    return spark.createDataFrame([(c, day(d), n, s, m) for c, d, n, s, m in rows], DDL)


def parts(spark, rows):
    return {r.cluster_id: r for r in trending.series_parts(series(spark, rows)).collect()}


def test_momentum_skips_a_null_day(spark):
    rows = series(spark, [("a", 0, 1, 0.1, None), ("a", 1, 1, None, None), ("a", 2, 1, 0.4, None)]).drop("momentum")
    got = [r.momentum for r in timeseries.add_momentum(rows).orderBy("summary_date").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.3)


def test_velocity_cases(spark):
    got = parts(spark, [
        ("zero", 0, 0, None, None), ("zero", 1, 5, None, None), ("flat", 0, 0, None, None), ("flat", 1, 0, None, None),
        ("one", 0, 9, 0.1, None), ("up", 0, 1, -1.0, None), ("up", 1, 3, 1.0, 0.5), ("null", 0, 1, None, None), ("null", 1, 1, 0.5, None),
    ])
    assert got["zero"].velocity == 0.5 and got["flat"].velocity == 0 and got["one"].velocity == 0 and got["up"].velocity == 0.5
    assert got["up"].sentiment == 1.0 and got["null"].sentiment == 0 and got["one"].sentiment == 0
    assert got["up"].momentum == 0.75 and got["zero"].momentum == 0


def test_momentum_uses_the_last_seven_rows(spark):
    got = parts(spark, [("a", d * 3, 1, 0.0, 1.0 if d < 3 else 0.0) for d in range(10)])
    assert got["a"].momentum == 0.5


def test_anomaly_weight_and_tomorrow(spark):
    rows = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 0.0), ("b", day(2), 1.0)], "cluster_id STRING, anomaly_date DATE, score DOUBLE")
    got = {r.cluster_id: r.anomaly for r in trending.anomaly_weight(rows, str(day(1))).collect()}
    assert got["a"] == pytest.approx((1 * 0.5 + 0 * 1) / 1.5 / 10)
    assert got["b"] is None


def test_undefined_score_keeps_the_old_one_and_no_series_scores_zero(spark):
    clusters = spark.createDataFrame([("a", 0.7), ("b", 0.4), ("c", None)], "id STRING, trending_score DOUBLE")
    rows = series(spark, [("a", 0, 1, 0.0, None), ("b", 0, 1, 0.0, None), ("b", 1, 1, 0.0, 0.0)])
    spikes = spark.createDataFrame([("a", day(2), 1.0)], "cluster_id STRING, anomaly_date DATE, score DOUBLE")
    scores = trending.trending_scores(clusters, rows, spikes, str(day(1)))
    got = {r.id: r.trending_score for r in trending.update_trending(clusters, scores).collect()}
    assert got["a"] == 0.7 and got["c"] == 0.0
    assert got["b"] == pytest.approx(0.3 / 6 + 0.25 * 0.5 + 0.25 * 0.5)


def test_lone_anomaly_scores_one_and_flat_series_has_none(spark):
    counts = [5, 6, 5, 7, 6, 5, 90, 6, 5, 7]
    rows = series(spark, [("spike", d, n, 0.1, None) for d, n in enumerate(counts)] + [("flat", d, 4, 0.0, 0.0) for d in range(10)])
    got = anomaly.normalize_scores(anomaly.volume_anomalies(rows)).collect()
    assert [(r.cluster_id, r.anomaly_date, r.score, r.direction) for r in got] == [("spike", day(6), 1.0, 1)]
    assert anomaly.volume_anomalies(rows.where("summary_date < '2024-01-03'")).count() == 0
    assert anomaly.contamination_or_default(0.7) == 0.1 and anomaly.contamination_or_default(0.5) == 0.5


def test_isolation_forest_ranks_like_the_closed_form(spark):
    counts = [5, 6, 5, 7, 6, 5, 90, 6, 5, 40]
    rows = series(spark, [("a", d, n, 0.0, 0.0) for d, n in enumerate(counts)])
    score = {r.summary_date: r.score for r in anomaly.isolation_forest(rows, ["mention_count"], chunk_rows=3).collect()}
    assert sorted(score, key=score.get)[-2:] == [day(9), day(6)] and len(score) == 10


def test_isolation_forest_samples_long_series(spark):
    """A series longer than the sample keeps its outliers on top, beside one that every tree sees whole."""
    rows = series(spark, [("long", d, 1000 if d == 700 else d % 7, 0.0, 0.0) for d in range(900)] + [("short", d, 50 if d == 3 else 5, 0.0, 0.0) for d in range(10)])
    scored = anomaly.isolation_forest(rows, ["mention_count"], trees=30, subsample=64, chunk_rows=200)
    assert scored.count() == 910
    top = {r.cluster_id: r.d for r in scored.groupBy("cluster_id").agg(F.max_by("summary_date", "score").alias("d")).collect()}
    assert top == {"long": day(700), "short": day(3)}


def test_forecast_needs_two_days_and_covers_the_future(spark):
    rows = series(spark, [("a", d, 10 + d, 0.0, 0.0) for d in range(15)] + [("b", 0, 3, 0.0, 0.0)])
    bands = timeseries.forecast_band(rows)
    got = {(r.cluster_id, r.summary_date): r for r in bands.collect()}
    assert {c for c, _ in got} == {"a"} and len(got) == 22
    assert got[("a", day(20))].forecast_lower == pytest.approx(30, abs=1e-6)
    merged = timeseries.merge_forecast(rows, bands)
    assert merged.where("is_forecast").count() == 7
    assert timeseries.observed_only(merged).count() == 16 and timeseries.observed_only(merged, True).count() == 23


def test_scores(spark):
    row = spark.range(1).select(
        combine_scores(F.lit(None).cast("double"), F.lit(0.4)).alias("one"), combine_scores(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("none"),
        sentiment_label(F.lit(0.3)).alias("p"), sentiment_label(F.lit(-0.3)).alias("n"), sentiment_label(F.lit(None).cast("double")).alias("u"),
        confidence(F.lit(100)).alias("c100"), confidence(F.lit(29)).alias("c29"), confidence(F.lit(0)).alias("c0"), confidence(F.lit(None).cast("int")).alias("cn"),
    ).first()
    assert (row.one, row.none, row.p, row.n, row.u) == (0.4, None, "positive", "negative", "unknown")
    assert (row.c100, row.c29, row.c0, row.cn) == (0.8, 0.6, 0.7, 0.7)
