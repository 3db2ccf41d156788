"""Cluster statistics, daily series, anomalies and trending."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AS_OF, DIM
from checks.registry import day_text, exploded_vector, query, r6, rounded
from trendloom.operators import anomaly, clustering, timeseries, trending

# ---------------------------------------------------------------- cluster statistics


@query("g8_cluster_centroids", f"""
    SELECT cluster_id, CAST(i - 1 AS INT) AS dim, {r6('v')} AS value FROM d_vec_sums""")
def _(v):
    return exploded_vector(v.centroids(), "centroid", "cluster_id")


@query("g9_cluster_avg_sentiment", f"""
    SELECT m.cluster_id, {r6('avg(s.combined_score)')} AS avg_sentiment
    FROM d_members m LEFT JOIN d_sentiments s USING (document_id) GROUP BY 1""")
def _(v):
    return rounded(clustering.cluster_avg_sentiment(v.members(), v.sentiments()), "avg_sentiment")


@query("g10_membership_strength", f"""
    SELECT cluster_id, document_id, {r6('membership_strength')} AS membership_strength FROM d_members""")
def _(v):
    return rounded(v.members(), "membership_strength")


@query("g11_new_clusters", f"""
    SELECT e.label AS id, e.document_id % 5 AS user_id, count(*) AS document_count, {r6('avg(s.combined_score)')} AS avg_sentiment,
           CAST(NULL AS DOUBLE) AS trending_score, {r6('avg(e.embedding[1])')} AS c_first, {r6(f'avg(e.embedding[{DIM}])')} AS c_last
    FROM (SELECT *, label * 10 + document_id % 5 AS k FROM d_embeddings) e LEFT JOIN d_sentiments s USING (document_id)
    GROUP BY e.label, e.document_id % 5, e.k""")
def _(v):
    rows = v.embeddings().withColumn("user_id", F.expr("document_id % 5"))
    rows = rows.withColumn("cluster_id", F.expr("label * 10 + document_id % 5"))
    found = clustering.new_clusters(rows, v.sentiments(), DIM)
    found = found.withColumn("id", F.expr("cast(floor(id / 10) AS INT)"))
    found = found.select("*", F.col("centroid")[0].alias("c_first"), F.col("centroid")[DIM - 1].alias("c_last")).drop("centroid")
    return rounded(found, "avg_sentiment", "c_first", "c_last")


@query("e4_valid_vectors", f"SELECT document_id FROM d_embeddings WHERE len(embedding) = {DIM}")
def _(v):
    return clustering.valid_vectors(v.embeddings(), DIM).select("document_id")


# ---------------------------------------------------------------- daily series

S_DAILY = """
    SELECT m.cluster_id, CAST(d.created_at AS DATE) AS summary_date, count(*) AS mention_count, avg(s.combined_score) AS avg_sentiment
    FROM d_members m JOIN d_documents d ON d.id = m.document_id JOIN d_sentiments s ON s.document_id = m.document_id GROUP BY 1, 2"""
S_SERIES = """
    SELECT *, avg_sentiment - last_value(avg_sentiment IGNORE NULLS) OVER (
        PARTITION BY cluster_id ORDER BY summary_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS momentum FROM s_daily"""
S_VIEWS = {"s_daily": S_DAILY, "s_series": S_SERIES}


def s_daily(v):
    return timeseries.daily_aggregates(v.members(), v.documents(), v.sentiments())


def s_series(v):
    return timeseries.add_momentum(s_daily(v))


@query("i1_daily_aggregates", f"""
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, mention_count, {r6('avg_sentiment')} AS avg_sentiment FROM s_daily""",
    **S_VIEWS)
def _(v):
    return day_text(rounded(s_daily(v), "avg_sentiment"), "summary_date")


@query("i2_momentum", f"""
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, {r6('momentum')} AS momentum FROM s_series""", **S_VIEWS)
def _(v):
    return day_text(rounded(s_series(v), "momentum"), "summary_date").select("cluster_id", "summary_date", "momentum")


FUTURE = """
    SELECT cluster_id, CAST(last_day + to_days(k::INT) AS DATE) AS summary_date
    FROM (SELECT cluster_id, max(summary_date) AS last_day FROM d_daily GROUP BY 1), range(1, 8) r(k)"""
BANDS = """
    SELECT p.cluster_id, p.summary_date, base + slope * (p.summary_date - s0) + coalesce(effect, 0) AS centre, sigma
    FROM (SELECT cluster_id, summary_date FROM d_daily UNION ALL SELECT cluster_id, summary_date FROM f_future) p
    JOIN f_fit USING (cluster_id)
    JOIN (SELECT cluster_id, stddev_samp(resid - effect) AS sigma FROM f_history GROUP BY 1) USING (cluster_id)
    LEFT JOIN (SELECT cluster_id, dow, max(effect) AS effect FROM f_history GROUP BY 1, 2) e
           ON e.cluster_id = p.cluster_id AND e.dow = dayofweek(p.summary_date)"""
FORECAST = {
    "f_future": FUTURE,
    "f_start": "SELECT cluster_id, min(summary_date) AS s0 FROM d_daily GROUP BY 1",
    "f_fit": """SELECT cluster_id, s0, regr_slope(mention_count, summary_date - s0) AS slope,
                       regr_intercept(mention_count, summary_date - s0) AS base
                FROM d_daily JOIN f_start USING (cluster_id) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "f_history": """SELECT *, avg(resid) OVER (PARTITION BY cluster_id, dow) AS effect FROM (
                    SELECT d.*, dayofweek(summary_date) AS dow, mention_count - (base + slope * (summary_date - s0)) AS resid
                    FROM d_daily d JOIN f_fit USING (cluster_id))""",
    "f_bands": BANDS,
}
LOWER = r6(f"centre - {timeseries.BAND_Z} * sigma")
UPPER = r6(f"centre + {timeseries.BAND_Z} * sigma")


@query("i3_forecast_band", f"""
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, {LOWER} AS forecast_lower, {UPPER} AS forecast_upper FROM f_bands""",
    **FORECAST)
def _(v):
    return day_text(rounded(timeseries.forecast_band(v.daily()), "forecast_lower", "forecast_upper"), "summary_date")


@query("i4_future_dates", "SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date FROM f_future", **FORECAST)
def _(v):
    return day_text(timeseries.future_dates(v.daily()), "summary_date")


@query("i5_merge_forecast", f"""
    SELECT b.cluster_id, strftime(b.summary_date, '%Y-%m-%d') AS summary_date, coalesce(mention_count, 0) AS mention_count,
           {r6('avg_sentiment')} AS avg_sentiment, {r6('momentum')} AS momentum, {LOWER} AS forecast_lower, {UPPER} AS forecast_upper,
           s.cluster_id IS NULL AS is_forecast
    FROM f_bands b LEFT JOIN d_series s USING (cluster_id, summary_date)""", **FORECAST)
def _(v):
    merged = timeseries.merge_forecast(v.series(), timeseries.forecast_band(v.daily()))
    return day_text(rounded(merged, "avg_sentiment", "momentum", "forecast_lower", "forecast_upper"), "summary_date")


@query("i6_replace_summaries", """
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, mention_count
    FROM d_daily WHERE cluster_id NOT IN ('click', 'view')
    UNION ALL
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d'), mention_count * 2 FROM d_daily WHERE cluster_id = 'click'""")
def _(v):
    current = v.daily().select("cluster_id", "summary_date", "mention_count")
    fresh = current.where("cluster_id = 'click'").withColumn("mention_count", F.col("mention_count") * 2)
    done = current.where("cluster_id IN ('click', 'view')").select("cluster_id")
    return day_text(timeseries.replace_summaries(current, fresh, done), "summary_date")


# ---------------------------------------------------------------- anomalies


def z_sql(expression: str) -> str:
    w = "OVER (PARTITION BY cluster_id)"
    return f"CASE WHEN stddev_pop({expression}) {w} > 1e-12 THEN ({expression} - avg({expression}) {w}) / stddev_pop({expression}) {w} ELSE 0 END"


A_VIEWS = {
    "a_points": f"""
        SELECT cluster_id, summary_date, mention_count, avg_sentiment, momentum, {z_sql('mention_count::DOUBLE')} AS z_count,
               {z_sql('coalesce(avg_sentiment, 0)')} AS z_sentiment, {z_sql('coalesce(momentum, 0)')} AS z_momentum,
               count(*) OVER (PARTITION BY cluster_id) AS n
        FROM d_series""",
    "a_ready": "SELECT * FROM a_points WHERE n >= 3",
    "v_values": """
        SELECT cluster_id, x, ties, lead(x) OVER (PARTITION BY cluster_id ORDER BY x) AS nx
        FROM (SELECT cluster_id, mention_count::DOUBLE AS x, count(*) AS ties FROM a_ready GROUP BY 1, 2)""",
    "v_depth": """
        SELECT p.cluster_id, p.x, coalesce(sum((g.nx - g.x) / CASE WHEN g.x >= p.x THEN g.nx - p.x ELSE p.x - g.x END), 0)
               + CASE WHEN p.ties > 2 THEN 2 * (ln(p.ties - 1) + 0.5772156649) - 2 * (p.ties - 1) / p.ties::DOUBLE
                      WHEN p.ties = 2 THEN 1 ELSE 0 END AS depth
        FROM v_values p LEFT JOIN v_values g ON g.cluster_id = p.cluster_id AND g.nx IS NOT NULL
        GROUP BY p.cluster_id, p.x, p.ties""",
    "v_scored": """
        SELECT r.*, round(pow(2, -depth / (2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n::DOUBLE)), 6) AS score
        FROM a_ready r JOIN v_depth d ON d.cluster_id = r.cluster_id AND d.x = r.mention_count""",
    "v_flagged": """
        SELECT * FROM (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY cluster_id) AS cut FROM v_scored) WHERE score > cut""",
    "l_pairs": """
        SELECT a.cluster_id, a.summary_date, b.summary_date AS other, b.n,
               sqrt(pow(a.z_sentiment - b.z_sentiment, 2) + pow(a.z_momentum - b.z_momentum, 2)) AS d
        FROM a_ready a JOIN a_ready b ON a.cluster_id = b.cluster_id AND a.summary_date <> b.summary_date""",
    "l_near": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, summary_date ORDER BY round(d, 9), other) AS rn,
                       least(5, n - 1) AS k FROM l_pairs) WHERE rn <= k""",
    "l_kd": "SELECT cluster_id, summary_date, d AS kd FROM l_near WHERE rn = k",
    "l_lrd": """
        SELECT p.cluster_id, p.summary_date, 1 / (avg(greatest(p.d, q.kd)) + 1e-10) AS lrd
        FROM l_near p JOIN l_kd q ON q.cluster_id = p.cluster_id AND q.summary_date = p.other GROUP BY 1, 2""",
    "l_scored": """
        SELECT p.cluster_id, p.summary_date, round(avg(q.lrd) / max(o.lrd), 6) AS score
        FROM l_near p JOIN l_lrd q ON q.cluster_id = p.cluster_id AND q.summary_date = p.other
        JOIN l_lrd o ON o.cluster_id = p.cluster_id AND o.summary_date = p.summary_date GROUP BY 1, 2""",
    "l_flagged": """
        SELECT s.*, a.z_sentiment FROM (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY cluster_id) AS cut FROM l_scored) s
        JOIN a_ready a USING (cluster_id, summary_date) WHERE score > cut""",
    "a_raw": """
        SELECT cluster_id, summary_date AS anomaly_date, 'volume_spike' AS type, score, sign(z_count)::INT AS direction FROM v_flagged
        UNION ALL SELECT cluster_id, summary_date, 'sentiment_spike', score, sign(z_sentiment)::INT FROM l_flagged""",
    "a_all": """
        SELECT cluster_id, anomaly_date, type, direction, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS score
        FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM a_raw WINDOW w AS (PARTITION BY cluster_id, type))""",
}
RAW_COLUMNS = ("cluster_id", "anomaly_date", "type", "score", "direction")


def _anomaly_rows(df):
    return day_text(rounded(df.select(*RAW_COLUMNS), "score"), "anomaly_date")


def _anomaly_sql(view: str, where: str = "true") -> str:
    return (f"SELECT cluster_id, strftime(anomaly_date, '%Y-%m-%d') AS anomaly_date, type, {r6('score')} AS score, direction "
            f"FROM {view} WHERE {where}")


@query("j1_anomaly_features", f"""
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, {r6('z_count')} AS z_count,
           {r6('z_sentiment')} AS z_sentiment, {r6('z_momentum')} AS z_momentum FROM a_points""", **A_VIEWS)
def _(v):
    rows = anomaly.anomaly_features(v.series()).select("cluster_id", "summary_date", "z_count", "z_sentiment", "z_momentum")
    return day_text(rounded(rows, "z_count", "z_sentiment", "z_momentum"), "summary_date")


@query("j2_contamination_guard", _anomaly_sql("a_raw", "type = 'volume_spike'"), **A_VIEWS)
def _(v):
    return _anomaly_rows(anomaly.volume_anomalies(v.series(), contamination=0.7))


# customers' order days per segment and priority give many short series
SHORT = """
    SELECT c_mktsegment || o_custkey AS cluster_id, CAST(o_orderdate AS DATE) AS summary_date, count(*) AS mention_count,
           avg(o_totalprice) / 1000000 AS avg_sentiment, CAST(NULL AS DOUBLE) AS momentum
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


@query("j3_min_points_guard", """
    SELECT cluster_id, count(*) AS days FROM d_short GROUP BY 1 HAVING count(*) >= 3""", d_short=SHORT)
def _(v):
    orders = v.table("orders").join(v.table("customer").select("c_custkey", "c_mktsegment"), F.expr("o_custkey = c_custkey"))
    short = orders.groupBy(F.concat("c_mktsegment", "o_custkey").alias("cluster_id"), F.to_date("o_orderdate").alias("summary_date"))
    series = short.agg(F.count(F.lit(1)).alias("mention_count"), (F.avg("o_totalprice") / 1000000).alias("avg_sentiment"))
    series = series.withColumn("momentum", F.lit(None).cast("double"))
    return anomaly._gathered(series).select("cluster_id", F.size("p").cast("bigint").alias("days"))


@query("j4_volume_anomalies", _anomaly_sql("a_raw", "type = 'volume_spike'"), **A_VIEWS)
def _(v):
    return _anomaly_rows(anomaly.volume_anomalies(v.series()))


@query("j5_isolation_forest")
def _(v):
    return rounded(anomaly.isolation_forest(v.series(), ["mention_count", "avg_sentiment", "momentum"]), "score")


@query("j5_forest_against_closed_form", """
    SELECT cluster_id, count(*) AS days, 1 AS scores_are_shares, 1 AS top_day_is_extreme FROM d_series GROUP BY 1""")
def _(v):
    """The forest over mentions alone: its highest score stands on the least or the greatest day of the series."""
    scored = anomaly.isolation_forest(v.series(), ["mention_count"])
    days = scored.join(v.series().select("cluster_id", "summary_date", "mention_count"), ["cluster_id", "summary_date"])
    per = days.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("score").alias("low"), F.max("score").alias("high"), F.max_by("mention_count", F.round("score", 9)).alias("top"),
        F.min("mention_count").alias("least"), F.max("mention_count").alias("most"))
    return per.select(
        "cluster_id", "days", F.when((F.col("low") > 0) & (F.col("high") < 1), 1).otherwise(0).alias("scores_are_shares"),
        F.when((F.col("top") == F.col("least")) | (F.col("top") == F.col("most")), 1).otherwise(0).alias("top_day_is_extreme"))


@query("j6_sentiment_anomalies", _anomaly_sql("a_raw", "type = 'sentiment_spike'"), **A_VIEWS)
def _(v):
    return _anomaly_rows(anomaly.sentiment_anomalies(v.series()))


@query("j7_normalize_scores", _anomaly_sql("a_all", "type = 'volume_spike'"), **A_VIEWS)
def _(v):
    return _anomaly_rows(anomaly.normalize_scores(anomaly.volume_anomalies(v.series())))


@query("j8_detect_anomalies", _anomaly_sql("a_all"), **A_VIEWS)
def _(v):
    return _anomaly_rows(anomaly.detect_anomalies(v.series()))


@query("j9_replace_anomalies", _anomaly_sql("a_raw", "cluster_id <> 'click'")
       + " UNION ALL " + _anomaly_sql("a_all", "cluster_id = 'click'"), **A_VIEWS)
def _(v):
    current = anomaly.volume_anomalies(v.series()).unionByName(anomaly.sentiment_anomalies(v.series()))
    click = v.series().where("cluster_id = 'click'")
    return _anomaly_rows(anomaly.replace_anomalies(current, anomaly.detect_anomalies(click), click.select("cluster_id")))


# ---------------------------------------------------------------- trending

K_VIEWS = {
    **A_VIEWS,
    "k_series": f"SELECT * FROM d_series WHERE summary_date >= DATE '{AS_OF}' - 30",
    "k_ends": """
        SELECT cluster_id, count(*) AS days, arg_min(mention_count, summary_date) AS n0, arg_max(mention_count, summary_date) AS n1,
               arg_min(struct_pack(s := avg_sentiment), summary_date).s AS s0, arg_max(struct_pack(s := avg_sentiment), summary_date).s AS s1,
               avg(recent) AS recent
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY summary_date DESC) <= 7 THEN momentum END AS recent FROM k_series)
        GROUP BY 1""",
    "k_parts": """
        SELECT cluster_id,
               CASE WHEN days < 2 THEN 0 WHEN n0 = 0 THEN CASE WHEN n1 > 0 THEN least(1, n1 / 10.0) ELSE 0 END
                    ELSE least(1, greatest(0, ((n1 - n0) / n0::DOUBLE + 1) / 6)) END AS velocity,
               CASE WHEN recent IS NULL THEN 0 ELSE least(1, greatest(0, (recent + 1) / 2)) END AS momentum,
               CASE WHEN days < 2 OR s0 IS NULL OR s1 IS NULL THEN 0 ELSE least(1, greatest(0, (s1 - s0 + 2) / 4)) END AS sentiment
        FROM k_ends""",
    "k_anomaly": f"""
        SELECT cluster_id, least(1, greatest(0, sum(score * w) / sum(w) / 10)) AS anomaly
        FROM (SELECT *, 1.0 / (1 + (DATE '{AS_OF}' - anomaly_date)) AS w FROM a_all WHERE anomaly_date >= DATE '{AS_OF}' - 30) GROUP BY 1""",
    "k_score": """
        SELECT p.cluster_id, velocity, momentum, sentiment, coalesce(anomaly, 0) AS anomaly,
               least(1, greatest(0, 0.3 * velocity + 0.25 * momentum + 0.25 * sentiment + 0.2 * coalesce(anomaly, 0))) AS trending_score
        FROM k_parts p LEFT JOIN k_anomaly USING (cluster_id)""",
}


@query("k1_lookback", f"""
    SELECT cluster_id, strftime(summary_date, '%Y-%m-%d') AS summary_date, mention_count
    FROM d_series WHERE summary_date >= DATE '2024-01-20' - 10""")
def _(v):
    rows = trending.lookback(v.series(), "2024-01-20", 10)
    return day_text(rows.select("cluster_id", "summary_date", "mention_count"), "summary_date")


@query("k2_velocity", f"SELECT cluster_id, {r6('velocity')} AS velocity FROM k_parts", **K_VIEWS)
def _(v):
    return rounded(trending.velocity(trending.lookback(v.series(), AS_OF)), "velocity")


@query("k3_momentum_score", f"SELECT cluster_id, {r6('momentum')} AS momentum FROM k_parts", **K_VIEWS)
def _(v):
    return rounded(trending.momentum_score(trending.lookback(v.series(), AS_OF)), "momentum")


@query("k4_sentiment_change", f"SELECT cluster_id, {r6('sentiment')} AS sentiment FROM k_parts", **K_VIEWS)
def _(v):
    return rounded(trending.sentiment_change(trending.lookback(v.series(), AS_OF)), "sentiment")


@query("k5_anomaly_weight", f"SELECT cluster_id, {r6('anomaly')} AS anomaly FROM k_anomaly", **K_VIEWS)
def _(v):
    recent = trending.lookback(anomaly.detect_anomalies(v.series()), AS_OF, column="anomaly_date")
    return rounded(trending.anomaly_weight(recent, AS_OF), "anomaly")


def _scores(v):
    ids = v.table("events").select(F.col("event_type").alias("id")).distinct()
    return trending.trending_scores(ids, v.series(), anomaly.detect_anomalies(v.series()), AS_OF)


@query("k6_trending_score", f"""
    SELECT cluster_id, {r6('velocity')} AS velocity, {r6('momentum')} AS momentum, {r6('sentiment')} AS sentiment,
           {r6('anomaly')} AS anomaly, {r6('trending_score')} AS trending_score FROM k_score""", **K_VIEWS)
def _(v):
    return rounded(_scores(v), "velocity", "momentum", "sentiment", "anomaly", "trending_score")


# Forecast rows kept: every velocity ends at a zero count, and the sentiment parts vanish.
@query("k6_trending_with_forecast_rows", f"""
    SELECT cluster_id, 0.0 AS velocity, 0.0 AS momentum, 0.0 AS sentiment FROM (SELECT DISTINCT cluster_id FROM f_bands)""",
    **FORECAST)
def _(v):
    merged = timeseries.merge_forecast(v.series(), timeseries.forecast_band(v.daily()))
    kept = timeseries.observed_only(merged, include_forecast_rows=True)
    return trending.series_parts(trending.lookback(kept, AS_OF)).select("cluster_id", "velocity", "momentum", "sentiment")


@query("k7_update_trending", f"""
    SELECT l.id, coalesce({r6('k.trending_score')}, 0.5) AS trending_score
    FROM (SELECT DISTINCT event_type AS id FROM events UNION SELECT DISTINCT c_mktsegment FROM customer) l
    LEFT JOIN k_score k ON k.cluster_id = l.id""", **K_VIEWS)
def _(v):
    kinds = v.table("events").select(F.col("event_type").alias("id"))
    clusters = kinds.union(v.table("customer").select("c_mktsegment")).distinct().withColumn("trending_score", F.lit(0.5))
    return rounded(trending.update_trending(clusters, _scores(v)), "trending_score")
