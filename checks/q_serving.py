"""Vector search and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AS_OF, DIM
from checks.q_series import A_VIEWS, s_series
from checks.q_text import I_VIEWS, _anoms, _insights, _keywords, embedding_views
from checks.registry import day_text, query, r6, rounded
from trendloom.operators import anomaly, clustering, embedding, search, serving
from trendloom.operators.neighbours import knn_graph
from trendloom.runtime import shared_dir
from trendloom.sources.stored import conform

NOW = f"timestamp'{AS_OF} 00:00:00'"

# ---------------------------------------------------------------- search

QUERY = "(SELECT embedding FROM d_embeddings WHERE document_id = 7)"
DISTANCE = f"list_cosine_distance(e.embedding, {QUERY})"


def _query_vector(v):
    return v.embeddings().where("document_id = 7").first()["embedding"]


def search_sql(extra_from: str, where: str, limit: int, columns: str = "document_id") -> str:
    return f"""SELECT {columns}, {r6('distance')} AS distance FROM (
        SELECT e.*, {DISTANCE} AS distance FROM d_embeddings e) e {extra_from} WHERE {where} ORDER BY round(distance, 9), document_id LIMIT {limit}"""


@query("n1_search_embeddings", search_sql("", "true", 10))
def _(v):
    return rounded(search.search_embeddings(v.embeddings(), _query_vector(v), dim=DIM), "distance")


@query("n2_distance_threshold", search_sql("", "distance <= 0.9", 100))
def _(v):
    return rounded(search.search_embeddings(v.embeddings(), _query_vector(v), 100, dim=DIM, max_distance=0.9), "distance")


@query("n3_owner_scoped_search", search_sql("JOIN d_documents d ON d.id = e.document_id", "d.user_id = 2", 10))
def _(v):
    return rounded(search.search_embeddings(v.embeddings(), _query_vector(v), dim=DIM, documents=v.documents(), user_id=2), "distance")


@query("n4_search_documents", f"""
    SELECT d.id, d.title, d.source_path, h.distance FROM ({search_sql("", "true", 10)}) h JOIN d_documents d ON d.id = h.document_id""")
def _(v):
    found = search.search_documents(v.embeddings(), v.documents(), _query_vector(v), dim=DIM)
    return rounded(found.select("id", "title", "source_path", "distance"), "distance")


PHRASE = "the con of sch that than"
N5_VIEWS = {
    **embedding_views(f"SELECT id, raw_text FROM d_documents UNION ALL SELECT -1, '{PHRASE}'"),
    "n5_dots": """SELECT a.document_id, sum(a.v * b.v) AS s FROM e_vec a JOIN e_vec b ON b.document_id = -1 AND a.dim = b.dim
                  WHERE a.document_id <> -1 GROUP BY 1""",
}


@query("n5_semantic_search", f"""
    SELECT id, d.title, d.source_path, {r6('1 - coalesce(s, 0)')} AS similarity_score
    FROM d_documents d LEFT JOIN n5_dots ON document_id = id
    WHERE id IN (SELECT document_id FROM e_vec) ORDER BY round(1 - coalesce(s, 0), 9), id LIMIT 10""", **N5_VIEWS)
def _(v):
    vectors = embedding.embed_documents(v.documents(), DIM)
    found = search.semantic_search(v.spark, f"  {PHRASE} ", vectors, v.documents(), dim=DIM)
    return rounded(found.drop("created_at"), "similarity_score")


PAIRS = """SELECT a.document_id AS query_id, b.document_id, list_cosine_distance(a.embedding, b.embedding) AS distance
           FROM d_embeddings a, d_embeddings b"""


def knn_sql(where: str, k: int) -> str:
    return f"""SELECT query_id, document_id, CAST(rank AS INT) AS rank, {r6('distance')} AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), document_id) AS rank FROM n_pairs WHERE {where}) WHERE rank <= {k}"""


@query("n6_batch_search", knn_sql("true", 10), n_pairs=PAIRS)
def _(v):
    queries = v.embeddings().withColumnRenamed("document_id", "query_id")
    return rounded(search.batch_search(queries, v.embeddings()), "distance")


@query("m2_knn_graph", knn_sql("query_id <> document_id AND query_id % 5 = document_id % 5", 15), n_pairs=PAIRS)
def _(v):
    rows = v.embeddings().withColumn("user_id", F.expr("document_id % 5"))
    found = knn_graph(rows, 15, group="user_id")
    return rounded(found.select("query_id", F.col("neighbour_id").alias("document_id"), "rank", "distance"), "distance")


@query("n7_ann_search")
def _(v):
    centres = search.list_centres(v.embeddings(), lists=20)
    path = shared_dir(v.spark, "lists")
    search.write_lists(v.embeddings(), centres, path)
    return rounded(search.ann_search(v.spark, path, centres, _query_vector(v), n_probe=4), "distance")


@query("n7_ann_all_lists", search_sql("JOIN d_documents d ON d.id = e.document_id", "d.user_id = 2 AND e.document_id % 11 <> 0", 10))
def _(v):
    """Lists written in two parts, some vectors retired, an owner's filter: with all lists probed the result is exact."""
    centres = search.list_centres(v.embeddings(), lists=20)
    path = shared_dir(v.spark, "lists")
    search.write_lists(v.embeddings().where("document_id % 3 = 0"), centres, path, v.documents())
    search.write_lists(v.embeddings().where("document_id % 3 <> 0"), centres, path, v.documents(), mode="append")
    search.retire_vectors(v.embeddings().where("document_id % 11 = 0"), path)
    return rounded(search.ann_search(v.spark, path, centres, _query_vector(v), n_probe=20, user_id=2), "distance")


@query("n7_ann_recall", "SELECT count(*) AS queries, 10 * count(*) AS found, 1 AS recall_is_enough, 1 AS reads_less_than_half FROM d_embeddings")
def _(v):
    """Recall at ten of the inverted lists against exact search, every vector a query."""
    queries = v.embeddings().withColumnRenamed("document_id", "query_id")
    centres = search.list_centres(v.embeddings(), lists=20)
    near = v.stored("near", lambda: search.ann_batch_search(queries, v.embeddings(), centres, n_probe=9))
    exact = v.stored("exact", lambda: search.batch_search(queries, v.embeddings()))
    hits = near.join(exact, ["query_id", "document_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    totals = near.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"))
    return totals.join(hits).select(
        "queries", "found", F.when(F.col("hits") >= 0.9 * F.col("found"), 1).otherwise(0).alias("recall_is_enough"), F.lit(int(2 * 9 < len(centres))).alias("reads_less_than_half"))


@query("n7_ann_batch_search")
def _(v):
    queries = v.embeddings().withColumnRenamed("document_id", "query_id")
    centres = search.list_centres(v.embeddings(), lists=20)
    return rounded(search.ann_batch_search(queries, v.embeddings(), centres, n_probe=4), "distance")


# ---------------------------------------------------------------- serving

DOCS = "id, user_id, ingest_event_id, source_path, title, processed, processed_at, created_at, updated_at"


def _docs(v):
    return v.documents()


@query("o1_list_documents", f"SELECT {DOCS} FROM d_documents WHERE user_id = 3 ORDER BY created_at DESC, id LIMIT 20 OFFSET 5")
def _(v):
    return serving.list_documents(_docs(v), 3, limit=20, offset=5).rows


@query("o1_list_documents_filtered", f"""
    SELECT {DOCS} FROM d_documents d WHERE user_id = 3 AND ingest_event_id IN (SELECT id FROM d_events WHERE lower(source) = 'src3')
      AND id IN (SELECT document_id FROM d_sentiments WHERE combined_score BETWEEN -0.6 AND 0.5)
    ORDER BY created_at DESC, id LIMIT 10000""")
def _(v):
    return serving.list_documents(
        _docs(v), 3, source="Src3", min_sentiment=-0.6, max_sentiment=0.5, events=v.events(), sentiments=v.sentiments(), limit=10000
    ).rows


@query("o1_list_documents_processed", f"SELECT {DOCS} FROM d_documents WHERE user_id = 3 AND processed AND ingest_event_id = 8 ORDER BY created_at DESC, id LIMIT 10000")
def _(v):
    return serving.list_documents(_docs(v), 3, processed=True, ingest_event_id=8, limit=10000).rows


@query("o1_list_documents_of_cluster", f"""
    SELECT {DOCS} FROM d_documents d WHERE user_id = 3 AND id IN (SELECT document_id FROM d_members WHERE cluster_id = 3)
    ORDER BY created_at DESC, id LIMIT 10000""")
def _(v):
    return serving.list_documents(_docs(v), 3, cluster_id=3, members=v.members(), limit=10000).rows


@query("o2_document_detail", f"""
    SELECT d.id, d.title, d.raw_text, s.vader, s.combined_score, m.cluster_id, {r6('m.membership_strength')} AS membership_strength
    FROM d_documents d LEFT JOIN d_sentiments s ON s.document_id = d.id LEFT JOIN d_members m ON m.document_id = d.id WHERE d.id = 12 AND d.user_id = 2""")
def _(v):
    one = serving.document_detail(_docs(v), v.sentiments(), v.members(), 2, 12)
    rows = one.select("id", "title", "raw_text", "sentiment.vader", "sentiment.combined_score", F.explode_outer("memberships").alias("m"))
    flat = rows.select("id", "title", "raw_text", "vader", "combined_score", "m.cluster_id", "m.membership_strength")
    return rounded(flat, "membership_strength")


SCORED = "SELECT *, CASE WHEN id % 3 <> 0 THEN id / 10.0::DOUBLE END AS trending_score FROM d_clusters"


def _clusters(v):
    return v.clusters().withColumn("trending_score", F.when(F.col("id") % 3 != 0, F.col("id") / 10.0))


@query("o3_list_clusters", f"""
    SELECT id, user_id, name, document_count, {r6('avg_sentiment')} AS avg_sentiment, trending_score, created_at, updated_at FROM o_clusters WHERE user_id = 1
    ORDER BY trending_score DESC NULLS LAST, id LIMIT 100""", o_clusters=SCORED)
def _(v):
    return rounded(serving.list_clusters(_clusters(v), 1).rows, "avg_sentiment")


@query("o4_cluster_detail", f"""
    SELECT c.id, c.name, 'member' AS part, d.title AS value, {r6('m.membership_strength')} AS number
    FROM d_clusters c JOIN d_members m ON m.cluster_id = c.id JOIN d_documents d ON d.id = m.document_id WHERE c.id = 4 AND c.user_id = 4
    UNION ALL SELECT 4, c.name, 'day', strftime(summary_date, '%Y-%m-%d'), mention_count FROM s_series JOIN d_clusters c ON c.id = cluster_id WHERE cluster_id = 4
    UNION ALL SELECT 4, c.name, 'anomaly', i.type, {r6('score')} FROM i_anoms i JOIN d_clusters c ON c.id = cluster_id WHERE cluster_id = 4
    UNION ALL SELECT 4, c.name, 'keyword', keyword, NULL FROM t_keywords JOIN d_clusters c ON c.id = cluster_id WHERE cluster_id = 4
    UNION ALL SELECT 4, c.name, 'insight', 'text', 0.7 FROM d_clusters c WHERE id = 4""", **I_VIEWS)
def _(v):
    insights = _insights(v).select(F.col("cluster_id").cast("string").alias("id"), "cluster_id", F.lit("text").alias("insight_text"), F.lit(0.7).alias("confidence"))
    stored = {
        "keywords": conform(_keywords(v), "keywords", F.expr(NOW)), "series": conform(s_series(v), "timeseries_summary", F.expr(NOW)),
        "insights": conform(insights, "insights", F.expr(NOW)), "anomalies": conform(_anoms(v), "anomalies", F.expr(NOW)),
    }
    found = serving.cluster_detail(_clusters(v), 4, 4, members=v.members(), documents=_docs(v), **stored)

    def flat(part, df, value, number):
        return df.select("cluster_id", F.lit(part).alias("part"), value.cast("string").alias("value"), number.cast("double").alias("number"))

    rows = flat("member", found.members, F.col("document_title"), F.col("membership_strength"))
    for more in (
        flat("day", found.timeseries, F.col("summary_date"), F.col("mention_count")), flat("anomaly", found.anomalies, F.col("type"), F.col("score")),
        flat("keyword", found.keywords, F.col("keyword"), F.lit(None)), flat("insight", found.insights, F.col("insight_text"), F.col("confidence")),
    ):
        rows = rows.unionByName(more)
    named = found.cluster.select("id", "name").join(rows.withColumnRenamed("cluster_id", "id"), "id")
    return rounded(named, "number")


INSIGHTS = """SELECT doc_id AS id, (doc_id % 10)::INT AS cluster_id, 'about ' || source AS insight_text, n_chars / 100000.0::DOUBLE AS confidence,
                     TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) AS generated_at FROM documents"""


def _insight_table(v):
    return v.table("documents").selectExpr(
        "doc_id AS id", "cast(doc_id % 10 AS INT) AS cluster_id", "concat('about ', source) AS insight_text", "n_chars / 100000.0D AS confidence",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 30 AS INT)) AS generated_at", "'{}' AS llm_metadata",
    )


@query("o5_list_insights", """
    SELECT id, cluster_id, generated_at FROM o_insights WHERE cluster_id IN (SELECT id FROM d_clusters WHERE user_id = 2) AND cluster_id = 7
    ORDER BY generated_at DESC, id LIMIT 50""", o_insights=INSIGHTS)
def _(v):
    return serving.list_insights(_insight_table(v), v.clusters(), 2, cluster_id=7, limit=50).rows.select("id", "cluster_id", "generated_at")


@query("o6_insight_detail", f"""
    SELECT id, cluster_id, insight_text, {r6('confidence')} AS confidence FROM o_insights
    WHERE id = 17 AND cluster_id IN (SELECT id FROM d_clusters WHERE user_id = 2)""", o_insights=INSIGHTS)
def _(v):
    found = serving.insight_detail(_insight_table(v), v.clusters(), 2, 17)
    return rounded(found.select("id", "cluster_id", "insight_text", "confidence"), "confidence")


OWNED_KINDS = "SELECT DISTINCT event_type AS id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS user_id FROM events"


@query("o7_list_anomalies", f"""
    SELECT cluster_id, strftime(anomaly_date, '%Y-%m-%d') AS anomaly_date, type, {r6('score')} AS score FROM a_all
    WHERE cluster_id IN (SELECT id FROM o_kinds WHERE user_id = 1) AND anomaly_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'
    ORDER BY anomaly_date DESC, cluster_id, type LIMIT 100""", **A_VIEWS, o_kinds=OWNED_KINDS)
def _(v):
    kinds = v.table("events").selectExpr("event_type AS id", "CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS user_id").distinct()
    stored = conform(anomaly.detect_anomalies(v.series()), "anomalies", F.expr(NOW))
    found = serving.list_anomalies(stored, kinds, 1, start="2024-01-03", end="2024-01-28").rows
    return day_text(rounded(found.select("cluster_id", "anomaly_date", "type", "score"), "score"), "anomaly_date")


@query("o8_list_ingest_events", "SELECT id, source, status FROM d_events WHERE user_id = 1 AND status = 'completed' ORDER BY started_at DESC, id LIMIT 25")
def _(v):
    return serving.list_ingest_events(v.events(), 1, status="completed", limit=25).rows.select("id", "source", "status")


@query("o9_ingest_event_detail", "SELECT id, source, status FROM d_events WHERE user_id = 2 AND id = 42")
def _(v):
    return serving.ingest_event_detail(v.events(), 2, 42).select("id", "source", "status")


# a map by the first two vector components stands in for a projection table
PROJECTIONS = "SELECT document_id, 'default' AS model_name, embedding[1] AS x, embedding[2] AS y FROM d_embeddings WHERE label <> 0"


def _projections(v):
    return v.embeddings().where("label <> 0").select("document_id", "model_name", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


@query("o10_cluster_projections", f"""
    SELECT m.document_id, d.title, d.source_path, m.cluster_id, {r6('x')} AS x, {r6('y')} AS y
    FROM d_members m JOIN d_documents d ON d.id = m.document_id JOIN o_places p ON p.document_id = m.document_id
    WHERE m.cluster_id = 6 AND d.user_id = 1""", o_places=PROJECTIONS)
def _(v):
    return rounded(serving.cluster_projections(v.members(), v.clusters(), _docs(v), _projections(v), 1, 6), "x", "y")


TWO = "SELECT document_id, cluster_id, membership_strength FROM d_members UNION ALL SELECT document_id, (cluster_id + 1) % 10, 0.5 FROM d_members"


def _two_memberships(v):
    second = v.members().selectExpr("cast((cluster_id + 1) % 10 AS INT) AS cluster_id", "document_id", "0.5D AS membership_strength")
    return v.members().unionByName(second)


PRIMARY = """SELECT document_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY membership_strength DESC NULLS LAST, cluster_id) AS rn FROM o_two) WHERE rn = 1"""


@query("o11_primary_cluster", "SELECT document_id, cluster_id FROM o_primary", o_two=TWO, o_primary=PRIMARY)
def _(v):
    return serving.primary_cluster(_two_memberships(v))


@query("o12_user_projections", f"""
    SELECT d.id AS document_id, d.title, d.source_path, m.cluster_id, {r6('x')} AS x, {r6('y')} AS y
    FROM d_documents d JOIN o_places p ON p.document_id = d.id LEFT JOIN o_primary m ON m.document_id = d.id
    WHERE d.user_id = 4 ORDER BY d.id LIMIT 1000""", o_places=PROJECTIONS, o_two=TWO, o_primary=PRIMARY)
def _(v):
    return rounded(serving.user_projections(_docs(v), _projections(v), _two_memberships(v), 4), "x", "y")


@query("o13_paginate_total", "SELECT count(*) AS total FROM d_documents WHERE user_id = 3")
def _(v):
    return serving.list_documents(_docs(v), 3, limit=5).total


# ---------------------------------------------------------------- clusters of existing themes

G_VIEWS = {
    # clusters hold the documents of the first twenty days; later ones are not clustered yet
    "g_members": "SELECT e.document_id, e.label AS cluster_id FROM d_embeddings e JOIN d_documents d ON d.id = e.document_id WHERE created_at < TIMESTAMP '2024-01-21'",
    "g_open": """SELECT e.*, d.user_id, d.created_at FROM d_embeddings e JOIN d_documents d ON d.id = e.document_id
                 WHERE e.document_id NOT IN (SELECT document_id FROM g_members)""",
    "g_pairs": """SELECT o.document_id, o.user_id, o.embedding, c.id AS cluster_id, list_cosine_similarity(o.embedding, c.centroid) AS s
                  FROM g_open o JOIN d_clusters c ON c.user_id = o.user_id""",
    "g_best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY round(1 - s, 9), cluster_id) AS rn FROM g_pairs) WHERE rn = 1 AND s >= 0.3""",
    "g_added": f"""SELECT cluster_id, i, sum(embedding[i]) AS s, count(*) AS m FROM g_best, range(1, {DIM + 1}) r(i) GROUP BY 1, 2""",
}


def _g_members(v):
    early = _docs(v).where("created_at < timestamp'2024-01-21'").select(F.col("id").alias("document_id"))
    return v.embeddings().join(early, "document_id", "left_semi").select("document_id", F.col("label").alias("cluster_id"))


def _g_open(v):
    return clustering.unclustered_embeddings(v.embeddings(), _docs(v), _g_members(v))


def _g_assigned(v):
    return clustering.assign_to_existing(_g_open(v), v.clusters(), DIM, threshold=0.3)


@query("g1_unclustered_embeddings", "SELECT document_id, user_id FROM g_open", **G_VIEWS)
def _(v):
    return _g_open(v).select("document_id", "user_id")


@query("g2_recent_only", f"SELECT document_id, user_id FROM g_open WHERE created_at >= DATE '{AS_OF}' - 7", **G_VIEWS)
def _(v):
    rows = clustering.unclustered_embeddings(v.embeddings(), _docs(v), _g_members(v), as_of=AS_OF, recent_days=7)
    return rows.select("document_id", "user_id")


@query("g3_partition_by_owner", "SELECT user_id, count(*) AS documents FROM g_open WHERE source IS NOT NULL GROUP BY 1".replace("WHERE source IS NOT NULL ", "WHERE document_id % 7 <> 0 "), **G_VIEWS)
def _(v):
    orphaned = _docs(v).withColumn("user_id", F.expr("CASE WHEN id % 7 <> 0 THEN user_id END"))
    rows = clustering.unclustered_embeddings(v.embeddings(), orphaned, _g_members(v))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"))


@query("g4_assign_to_existing", f"SELECT user_id, document_id, cluster_id, {r6('s')} AS membership_strength FROM g_best", **G_VIEWS)
def _(v):
    return rounded(_g_assigned(v), "membership_strength")


@query("g5_update_centroids", f"""
    SELECT c.id, CAST(i - 1 AS INT) AS dim, c.document_count + coalesce(m, 0) AS document_count,
           {r6('(c.centroid[i] * c.document_count + coalesce(s, 0)) / (c.document_count + coalesce(m, 0))')} AS value
    FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM d_clusters) c LEFT JOIN g_added a ON a.cluster_id = c.id AND a.i = c.i""".replace("AS i FROM", "AS i FROM").replace("CAST(i ", "CAST(c.i ").replace("centroid[i]", "centroid[c.i]"), **G_VIEWS)
def _(v):
    moved = clustering.update_centroids(v.clusters().select("id", "centroid", "document_count"), _g_assigned(v), v.embeddings(), DIM)
    return rounded(moved.select("id", "document_count", F.posexplode("centroid").alias("dim", "value")), "value")
