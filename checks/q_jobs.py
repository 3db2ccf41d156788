"""Density clustering, projections, whole-job stages and streaming forms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.fixtures import AS_OF, DIM, STOP_WORDS
from checks.flagship import ranked_clusters
from checks.q_series import A_VIEWS, FORECAST, K_VIEWS
from checks.q_serving import PAIRS
from checks.registry import day_text, query, r6, rounded
from trendloom.operators import anomaly, clustering, density, projection, sentiment, serving, timeseries, trending
from trendloom.plans.stages import Settings, Store, insight_stage, run_and_store, run_stages, signal_stage
from trendloom.runtime import cut_lineage, shared_dir
from trendloom.sources.stored import StoredTables
from trendloom.streaming import jobs


def _owned_vectors(v):
    return v.embeddings().select("document_id", "embedding", F.expr("document_id % 5").alias("user_id"))


# ---------------------------------------------------------------- density clustering


@query("g6_density_clusters")
def _(v):
    return density.density_clusters(_owned_vectors(v))


EPS = 1.2
CUT = {
    "n_pairs": PAIRS,
    "c_dist": """SELECT a.document_id AS a, b.document_id AS b, list_distance(a.embedding, b.embedding) AS d
                 FROM d_embeddings a JOIN d_embeddings b ON a.document_id % 5 = b.document_id % 5 AND a.document_id <> b.document_id""",
    "c_core": "SELECT a AS id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rn FROM c_dist) WHERE rn = 2",
    "c_edges": f"""SELECT a, b FROM c_dist JOIN c_core x ON x.id = a JOIN c_core y ON y.id = b WHERE greatest(d, x.core, y.core) <= {EPS}""",
}
CUT["c_label"] = """
    WITH RECURSIVE reach(id, seen) AS (
        SELECT document_id, document_id FROM d_embeddings
        UNION SELECT e.a, r.seen FROM reach r JOIN c_edges e ON e.b = r.id)
    SELECT id AS document_id, min(seen) AS first FROM reach GROUP BY 1"""


@query("g6_flat_cut", """
    SELECT document_id, CASE WHEN count(*) OVER (PARTITION BY first) >= 3 THEN first::VARCHAR ELSE '-1' END AS label FROM c_label""", **CUT)
def _(v):
    return density.flat_cut(_owned_vectors(v), EPS).select("document_id", "label")


@query("g7_drop_noise", "SELECT vec_id AS document_id, label FROM embeddings WHERE label <> 3")
def _(v):
    rows = v.embeddings().select("document_id", "label")
    noisy = rows.withColumn("tag", F.when(F.col("label") == 3, -1).otherwise(F.col("label")))
    return clustering.drop_noise(noisy, "tag").select("document_id", "label")


@query("g12_cluster_run_summary", """
    SELECT (SELECT count(*) FROM d_embeddings) AS embeddings_processed, (SELECT count(*) FROM d_clusters) AS clusters_created,
           (SELECT count(*) FROM d_members) AS members_created, (SELECT count(*) FROM d_sentiments) AS members_assigned_to_existing,
           (SELECT count(*) FROM d_documents) AS keywords_created, 'completed' AS status""")
def _(v):
    return clustering.run_summary(v.embeddings(), v.clusters(), v.members(), v.sentiments(), v.documents())


# ---------------------------------------------------------------- projections


@query("m1_project_2d")
def _(v):
    return rounded(projection.project_2d(_owned_vectors(v), group="user_id"), "x", "y", digits=4)


@query("m1_project_2d_pca")
def _(v):
    return rounded(projection.project_2d(v.embeddings(), method="pca"), "x", "y")


def map_neighbours(placed, k):
    """The ``k`` places nearest to each on its owner's map."""
    flat = placed.select("document_id", "user_id", F.array("x", "y").alias("embedding"))
    return projection.knn_graph(flat, k, key="document_id", vec="embedding", group="user_id", metric="euclidean")


@query("m1_layout_facts", "SELECT count(*) AS points, 1 AS all_finite, 1 AS keeps_more_neighbours_than_pca FROM d_embeddings")
def _(v):
    """Of the 15 nearest on the map, more are among the 15 nearest vectors than with principal components."""
    owned = v.stored("owned", lambda: _owned_vectors(v))
    near = v.stored("near", lambda: projection.knn_graph(owned, 15, key="document_id", vec="embedding", group="user_id").select("query_id", "neighbour_id"))

    def kept(layout, name):
        placed = layout.select("document_id", "x", "y").join(owned.select("document_id", "user_id"), "document_id")
        return map_neighbours(placed, 15).join(near, ["query_id", "neighbour_id"], "left_semi").agg(F.count(F.lit(1)).alias(name))

    graph = v.stored("map", lambda: projection.project_2d(owned, group="user_id"))
    facts = graph.agg(F.count(F.lit(1)).alias("points"), F.min(((F.abs("x") < 1e9) & (F.abs("y") < 1e9)).cast("int")).alias("all_finite"))
    hits = kept(graph, "by_graph").join(kept(projection.project_2d(owned, method="pca"), "by_pca"))
    return facts.join(hits).select("points", "all_finite", (F.col("by_graph") > F.col("by_pca")).cast("int").alias("keeps_more_neighbours_than_pca"))


def _places(v):
    rows = v.embeddings()
    current = rows.where("label < 6").select("document_id", "model_name", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    fresh = rows.where("label >= 4").select("document_id", "model_name", F.col("embedding")[2].alias("x"), F.col("embedding")[3].alias("y"))
    return projection.upsert_projections(current, fresh)


@query("m3_upsert_projections", f"""
    SELECT document_id, model_name, {r6('CASE WHEN label >= 4 THEN embedding[3] ELSE embedding[1] END')} AS x,
           {r6('CASE WHEN label >= 4 THEN embedding[4] ELSE embedding[2] END')} AS y FROM d_embeddings""")
def _(v):
    return rounded(_places(v).projections, "x", "y")


@query("m3_upsert_counts", "SELECT count(*) FILTER (label >= 6) AS created, count(*) FILTER (label IN (4, 5)) AS updated FROM d_embeddings")
def _(v):
    return _places(v).counts


# ---------------------------------------------------------------- whole job


def _settings():
    return Settings(dim=DIM, as_of=AS_OF, stop_words=STOP_WORDS, threshold=0.3)


def _empty_store(v, **tables):
    ids = v.spark.createDataFrame([], "id STRING, user_id BIGINT, centroid ARRAY<DOUBLE>, document_count BIGINT, avg_sentiment DOUBLE, trending_score DOUBLE, name STRING")
    members = v.spark.createDataFrame([], "cluster_id STRING, document_id BIGINT, membership_strength DOUBLE")
    parts = {
        "documents": v.documents(), "embeddings": v.embeddings().drop("label"), "sentiments": v.sentiments(),
        "clusters": ids, "members": members, "insights": v.spark.createDataFrame([], "cluster_id STRING"),
    }
    return Store(**(parts | tables))


@query("p1_run_stages_trending")
def _(v):
    out = run_stages(_empty_store(v), _settings())
    return out["clusters"].select("id", "user_id", "name", "document_count", "avg_sentiment", "trending_score")


def _known_clusters(v):
    return v.clusters().withColumn("trending_score", F.lit(None).cast("double"))


S_BANDS = {k: t.replace("d_daily", "s_daily") for k, t in FORECAST.items()}
P_VIEWS = {
    **S_BANDS,
    "s_daily": """SELECT m.cluster_id, CAST(d.created_at AS DATE) AS summary_date, count(*) AS mention_count, avg(s.combined_score) AS avg_sentiment
                  FROM d_members m JOIN d_documents d ON d.id = m.document_id JOIN d_sentiments s ON s.document_id = m.document_id GROUP BY 1, 2""",
    "s_series": """SELECT *, avg_sentiment - last_value(avg_sentiment IGNORE NULLS) OVER (
        PARTITION BY cluster_id ORDER BY summary_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS momentum FROM s_daily""",
    **{k: t.replace("d_series", "s_series") for k, t in A_VIEWS.items()},
}


R_VIEWS = {**{k: t.replace("d_series", "s_series") for k, t in K_VIEWS.items()}, **P_VIEWS}


@query("k8_ranked_clusters", f"""
    SELECT id, user_id, name, document_count, {r6('avg_sentiment')} AS avg_sentiment, {r6('coalesce(k.trending_score, 0)')} AS trending_score
    FROM d_clusters c LEFT JOIN k_score k ON k.cluster_id = c.id""", **R_VIEWS)
def _(v):
    return rounded(ranked_clusters(v.spark, v.dir), "avg_sentiment", "trending_score")


def _signals(v):
    members = cut_lineage(v.members(), "members")
    return signal_stage(_empty_store(v), _known_clusters(v), members, _settings())


@query("p1_series_stage", f"""
    SELECT b.cluster_id, strftime(b.summary_date, '%Y-%m-%d') AS summary_date, coalesce(mention_count, 0) AS mention_count, {r6('momentum')} AS momentum,
           {r6('centre - 1.2815515655446004 * sigma')} AS forecast_lower, s.cluster_id IS NULL AS is_forecast
    FROM f_bands b LEFT JOIN s_series s USING (cluster_id, summary_date)""", **P_VIEWS)
def _(v):
    rows = _signals(v)["series"].select("cluster_id", "summary_date", "mention_count", "momentum", "forecast_lower", "is_forecast")
    return day_text(rounded(rows, "momentum", "forecast_lower"), "summary_date")


@query("p1_anomaly_stage", f"SELECT cluster_id, strftime(anomaly_date, '%Y-%m-%d') AS anomaly_date, type, {r6('score')} AS score FROM a_all", **P_VIEWS)
def _(v):
    rows = _signals(v)["anomalies"].select("cluster_id", "anomaly_date", "type", "score")
    return day_text(rounded(rows, "score"), "anomaly_date")


@query("p1_insight_stage")
def _(v):
    from checks.q_text import _anoms, _keywords

    return insight_stage(_empty_store(v), _known_clusters(v), v.members(), _keywords(v), _anoms(v), _settings()).drop("generated_at")


# ---------------------------------------------------------------- streaming


def _event_stream(v):
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("i7_daily_window_stream", f"""
    SELECT event_type AS cluster_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS summary_date, count(*) AS mention_count, {r6('avg(value)')} AS avg_sentiment
    FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(v):
    scored = _event_stream(v).selectExpr("event_type AS cluster_id", "ts AS created_at", "value AS combined_score")
    path = shared_dir(v.spark, "daily")
    jobs.run_to_end(jobs.daily_window_stream(scored), path, shared_dir(v.spark, "progress"))
    return day_text(rounded(v.spark.read.parquet(path), "avg_sentiment"), "summary_date")


@query("p3_stream_dedupe", """
    SELECT user_id, count(*) AS items FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS n FROM events)
    WHERE NOT (event_type = 'click' AND n < 100) GROUP BY 1""")
def _(v):
    items = _event_stream(v).selectExpr(
        "user_id", "concat(event_type, '-', cast(floor(value) AS BIGINT)) AS dedupe_key", "cast(event_id AS STRING) AS item_id", "ts AS landed_at"
    )
    stored = v.table("events").where("event_type = 'click' AND value < 100").selectExpr(
        "user_id", "concat(event_type, '-', cast(floor(value) AS BIGINT)) AS source_path"
    )
    path = shared_dir(v.spark, "fresh")
    jobs.stream_dedupe(items, lambda: stored, path, shared_dir(v.spark, "progress"))
    return v.spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("items"))


def _score(v):
    def score(docs):
        scores = sentiment.lexicon_sentiment(docs, v.lexicon(), v.boosters(), v.negations())
        return sentiment.analyze_sentiment(docs, v.sentiments().limit(0), [scores])

    return score


def _facts(spark, **facts):
    """One row per fact; a frame stands for the number of its rows."""
    rows = [(name, value if isinstance(value, int) else value.count()) for name, value in facts.items()]
    return spark.createDataFrame(rows, "fact STRING, value BIGINT")


def _unlike(a, b, columns):
    """Rows of one frame and not of the other, numbers to six digits."""
    doubles = [f.name for f in a.select(*columns).schema if f.dataType.typeName() == "double"]
    x, y = rounded(a.select(*columns), *doubles), rounded(b.select(*columns), *doubles)
    return x.exceptAll(y).count() + y.exceptAll(x).count()


def all_pages(page, limit):
    """Rows of all pages, asked for until one is not full; ``page(limit, offset)`` gives one."""
    total, got = 0, limit
    while got == limit:
        got = page(limit, total).count()
        total += got
    return total


SERIES = ("cluster_id", "summary_date", "mention_count", "avg_sentiment", "momentum", "forecast_lower", "forecast_upper", "is_forecast")
ANOMALIES = ("cluster_id", "anomaly_date", "type", "score", "direction")


def _rebuilt(read, settings):
    """How far the stored tables are from what the stages give over the stored members."""
    members, documents, moods, clusters = read("cluster_members"), read("documents"), read("document_sentiments"), read("clusters")
    series = cut_lineage(timeseries.build_series(members, documents, moods), "series")
    spikes = cut_lineage(anomaly.detect_anomalies(timeseries.observed_only(series)), "anomalies")
    scores = trending.trending_scores(clusters, timeseries.observed_only(series), spikes, settings.as_of)
    sizes = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("document_count"))
    names = ("keywords", "timeseries_summary", "anomalies", "insights", "umap_projections")
    dated = {"insights": "generated_at"}
    return {
        "series_unlike": _unlike(series, read("timeseries_summary"), SERIES),
        "anomalies_unlike": _unlike(spikes, read("anomalies"), ANOMALIES),
        "scores_unlike": _unlike(scores.select(F.col("cluster_id").alias("id"), "trending_score"), clusters, ("id", "trending_score")),
        "sizes_unlike": _unlike(sizes, clusters, ("id", "document_count")),
        "documents_in_two_clusters": members.groupBy("document_id").count().where("count > 1"),
        "clusters_without_keywords": clusters.join(read("keywords").select(F.col("cluster_id").alias("id")), "id", "left_anti"),
        "clusters_without_insight": clusters.join(read("insights").select(F.col("cluster_id").alias("id")), "id", "left_anti"),
        "rows_without_id_or_date": sum(read(n).where(F.col("id").isNull() | F.col(dated.get(n, "created_at")).isNull()).count() for n in names),
    }


UNLIKE = ("series_unlike", "anomalies_unlike", "scores_unlike", "sizes_unlike", "documents_in_two_clusters", "clusters_without_keywords", "clusters_without_insight",
          "rows_without_id_or_date")
ZEROS = " UNION ALL ".join(f"SELECT '{n}' AS fact, 0::BIGINT AS value" for n in UNLIKE)
TEXTS = r"regexp_matches(raw_text, '\S')"


@query("p1_run_and_store", f"""
    {ZEROS} UNION ALL SELECT 'documents', count(*) FROM d_documents
    UNION ALL SELECT 'processed', count(*) FROM d_documents WHERE id % 3 = 0 OR (id IN (SELECT document_id FROM d_embeddings) AND id IN (SELECT document_id FROM d_sentiments))
    UNION ALL SELECT 'places', count(*) FROM d_embeddings WHERE document_id IN (SELECT id FROM d_documents)
    UNION ALL SELECT 'embeddings_open', count(*) FROM d_embeddings WHERE document_id IN (SELECT id FROM d_documents)
    UNION ALL SELECT 'clusters_not_listed', 0 UNION ALL SELECT 'detail_rows_missing', 0 UNION ALL SELECT 'places_not_served', 0""")
def _(v):
    """The whole batch job over stored tables; then its tables against a rebuild, and the serving lists over them."""
    settings = replace(_settings(), projection_options={"method": "pca"})
    store = StoredTables(v.spark, shared_dir(v.spark, "tables"), settings.now, buckets=4)
    for name, rows in (("documents", v.documents()), ("document_embeddings", v.embeddings()), ("document_sentiments", v.sentiments())):
        store.append(name, rows)
    summary = run_and_store(store, settings).first()
    clusters, members = store.read("clusters"), store.read("cluster_members")
    users = [str(u) for u in range(5)]
    listed = sum(serving.list_clusters(clusters, u, limit=10_000).total.first()["total"] for u in users)
    documents, places = store.read("documents"), store.read("umap_projections")
    served = sum(all_pages(lambda n, at, u=u: serving.user_projections(documents, places, members, u, limit=n, offset=at), 10_000) for u in users)
    first = clusters.orderBy("id").first()
    parts = {"keywords": "keywords", "series": "timeseries_summary", "insights": "insights", "anomalies": "anomalies", "members": "cluster_members"}
    detail = serving.cluster_detail(clusters, first["user_id"], first["id"], documents=store.read("documents"), **{k: store.read(t) for k, t in parts.items()})
    shown = (detail.keywords, detail.timeseries, detail.insights, detail.anomalies, detail.members)
    wanted = sum(store.read(t).where(F.col("cluster_id") == first["id"]).count() for t in parts.values())
    return _facts(
        v.spark, **_rebuilt(store.read, settings), documents=store.read("documents"), processed=store.read("documents").where("processed"), places=store.read("umap_projections"),
        embeddings_open=summary["embeddings_processed"], clusters_not_listed=clusters.count() - listed, detail_rows_missing=wanted - sum(d.count() for d in shown),
        places_not_served=store.read("umap_projections").count() - served,
    )


@query("p2_run_incremental", f"""
    {ZEROS} UNION ALL SELECT 'documents', count(*) FROM d_documents UNION ALL SELECT 'embeddings', count(*) FROM d_documents WHERE {TEXTS}
    UNION ALL SELECT 'sentiments', count(*) FROM d_documents WHERE {TEXTS} UNION ALL SELECT 'processed', count(*) FROM d_documents WHERE {TEXTS}
    UNION ALL SELECT 'places', count(*) FROM d_documents WHERE {TEXTS} UNION ALL SELECT 'batches', 2 UNION ALL SELECT 'changed_by_repeated_batch', 0
    UNION ALL SELECT 'untouched_clusters_written', 0""")
def _(v):
    """Landed documents, two files, through the incremental job; then the last batch once more."""
    landed = shared_dir(v.spark, "landed")
    documents = v.documents().drop("source")
    halves = [documents.where("id % 2 = 0"), documents.where("id % 2 = 1")]
    settings = replace(_settings(), projection_options={"method": "pca"})
    run = jobs.IncrementalRun(v.spark, shared_dir(v.spark, "tables"), settings, _score(v))
    checkpoint = shared_dir(v.spark, "progress")
    for half in halves:
        half.write.mode("append").parquet(landed)
        run.run(v.spark.readStream.schema(documents.schema).parquet(landed), checkpoint)
    names = ("documents", "cluster_members", "clusters", "timeseries_summary", "anomalies", "keywords")
    kept = {n: v.stored(f"kept-{n}", lambda t=n: run.read(t)) for n in names}
    run.process(halves[1], 1)
    changed = sum(_unlike(kept[n], run.read(n), [c for c in kept[n].columns if c != "centroid"]) for n in names)
    touched = run.tables.batch("touched", 1)
    beyond = sum(run.tables.batch(n, 1).select("cluster_id").distinct().join(touched, "cluster_id", "left_anti").count() for n in ("timeseries_summary", "anomalies", "keywords"))
    return _facts(
        v.spark, **_rebuilt(run.read, settings), documents=run.read("documents"), embeddings=run.read("document_embeddings"), sentiments=run.read("document_sentiments"),
        processed=run.read("documents").where("processed"), places=run.read("umap_projections"), batches=run.tables.committed(), changed_by_repeated_batch=changed,
        untouched_clusters_written=beyond,
    )
