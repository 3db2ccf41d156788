"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import Spark
from checks.q_jobs import all_pages
from trendloom.functions import vectors as V
from trendloom.operators import bookkeeping, clustering, search, serving, timeseries, trending
from trendloom.operators.subscriptions import requests
from trendloom.plans.subscribed import ingest_subscribed, subscribed_items
from trendloom.runtime import shared_dir
from trendloom.sources import landed, normalize, tables


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def v(spark, sf_dir):
    return Spark(spark, sf_dir)


def test_no_python_and_no_nested_loops_in_expression_operators(v):
    series = v.series()
    entries = landed.feed_entry_fields(v.feed_raw())
    for df in (
        normalize.normalize_feed_entry(entries), trending.series_parts(series), timeseries.forecast_band(series),
        clustering.membership_strength(v.embeddings().withColumnRenamed("label", "cluster_id"), v.centroids()),
        serving.primary_cluster(v.members()), bookkeeping.pending_sentiment_docs(v.documents(), v.sentiments()),
    ):
        text = plan(df)
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(v):
    docs = v.table("documents").selectExpr("doc_id AS id", "source AS user_id", "text AS raw_text", "lang AS created_at",
                                              *[f"lang AS {c}" for c in serving.DOCUMENT_COLUMNS if c not in ("id", "user_id", "created_at")])
    text = plan(serving.list_documents(docs, "src1", limit=5).rows)
    assert "EqualTo(source,src1)" in text and "TakeOrderedAndProject" in text
    assert "text:string" not in text.split("ReadSchema")[1].splitlines()[0]


def test_search_is_a_top_k_without_a_shuffle(v):
    text = plan(search.search_embeddings(v.embeddings(), [1.0] * 64, dim=64))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_per_group_limits_run_before_the_shuffle(v):
    text = plan(landed.first_per(v.feed_raw(), ["feed_url"], "pos", 50))
    assert text.count("WindowGroupLimit") >= 2
    items = v.feed_raw().select(F.col("feed_url").alias("user_id"), F.col("link").alias("dedupe_key"), "pos")
    assert plan(bookkeeping.dedupe_within_batch(items)).count("WindowGroupLimit") >= 2


def test_vector_sums_do_not_explode_rows(v):
    text = plan(V.sum_by(v.embeddings(), ["label"], "embedding", 64, "s"))
    assert "Generate" not in text and text.count("HashAggregate") >= 2


def _feed_rows(spark, rows):
    return spark.createDataFrame(
        [(1, 7, feed, pos, f"id{pos}", f"title {feed} {pos}", link, "", "", "", "", []) for feed, pos, link in rows],
        "user_id long, event_id long, feed_url string, pos long, id string, title string, link string, summary string, content string, published string, author string, tags array<string>")


def _stored(spark, rows=()):
    return spark.createDataFrame(list(rows), "user_id long, source_path string")


def test_first_of_equal_links_is_kept_in_number_order(spark):
    from pyspark.sql import functions as F

    from trendloom.plans.ingest import ingest

    feed = _feed_rows(spark, [("f", 10, "same"), ("f", 9, "same"), ("g", 1, "same"), ("g", 2, "own")])
    made = ingest({"feed": feed}, _stored(spark), F.current_timestamp())
    assert sorted(r["title"] for r in made.documents.collect()) == ["title f 9", "title g 2"]
    stats = made.stats.first()
    assert (stats["total_fetched"], stats["new_documents"], stats["duplicates"], stats["errors"]) == (4, 2, 2, 0)


def test_statistics_follow_the_flag(spark):
    from pyspark.sql import functions as F

    from trendloom.plans.ingest import ingest

    feed = _feed_rows(spark, [("f", 1, "same"), ("f", 2, "same"), ("f", 3, "other"), ("f", 4, "known")])
    made = ingest({"feed": feed}, _stored(spark, [(1, "known")]), F.current_timestamp(), within_batch=False)
    assert made.documents.count() == 3
    stats = made.stats.first()
    assert (stats["new_documents"], stats["duplicates"]) == (3, 1)


def test_long_links_are_known_again(spark):
    from pyspark.sql import functions as F

    from trendloom.plans.ingest import ingest

    links = ["http://h/" + "x" * 1100, "http://h/" + "x" * 1100 + "y"]
    feed = _feed_rows(spark, [("f", i, link) for i, link in enumerate(links)])
    first = ingest({"feed": feed}, _stored(spark), F.current_timestamp()).documents.select("user_id", "source_path")
    assert sorted(r["source_path"] for r in first.collect()) == links
    assert ingest({"feed": feed}, first, F.current_timestamp()).documents.count() == 0


def test_insights_of_the_engine_can_be_listed(spark):
    from pyspark.sql import functions as F

    from trendloom.operators import insight, serving

    made = spark.createDataFrame([("c1", "text one", 4), ("c2", "text two", 5)], "cluster_id string, content string, eval_count int")
    rows = insight.insight_rows(made, F.expr("timestamp'2024-01-31'"), "extractive", "plain")
    clusters = spark.createDataFrame([("c1", 1), ("c2", 2)], "id string, user_id long")
    page = serving.list_insights(rows, clusters, 1).rows.collect()
    assert [r["cluster_id"] for r in page] == ["c1"]
    assert serving.insight_detail(rows, clusters, 1, page[0]["id"]).count() == 1


def test_lists_refuse_tables_without_their_columns(spark):
    import pytest

    from trendloom.operators import serving

    with pytest.raises(ValueError, match="missing"):
        serving.list_clusters(spark.createDataFrame([(1, 1)], "id long, user_id long"), 1)


def test_dealt_items_carry_no_texts_and_payloads_are_kept_once(spark):
    landed = {"release": spark.createDataFrame([("acme", "r", "1", 7, "t", "n", "long text " * 50)], "owner STRING, repo STRING, pos STRING, id BIGINT, tag_name STRING, name STRING, body STRING").selectExpr(
        "*", "'http://x' AS html_url", "named_struct('login', 'dev') AS author", "'2024' AS created_at", "'2024' AS published_at", "false AS prerelease", "false AS draft")}
    params = '{"owner": "acme", "repo": "r", "include_commits": false, "include_issues": false, "include_prs": false}'
    events = spark.range(40).selectExpr("concat('e', id) AS id", "id AS user_id", "'github' AS source", f"'{params}' AS source_params")
    items, contents = subscribed_items(landed, requests(events.withColumnRenamed("id", "event_id"), keep=("event_id",)), archive=True)
    assert items.count() == 40 and not {"doc_text", "payload"} & set(items.columns)
    assert contents.count() == 1
    made = ingest_subscribed(events, landed, spark.createDataFrame([], "user_id BIGINT, source_path STRING"), F.current_timestamp(), archive=True)
    assert made.documents.where("length(raw_text) > 400").count() == 40 and made.payloads.count() == 1
    path = shared_dir(spark, "archive")
    tables.archive_snapshots(made.snapshots, path, "2024-01-31", made.payloads)
    tables.archive_snapshots(made.snapshots, path, "2024-01-31", made.payloads)
    kept = spark.read.parquet(path)
    assert kept.count() == 40 and kept.where("get_json_object(payload, '$.body') LIKE 'long text%'").count() == 40


def test_places_beyond_the_first_page_are_served(spark):
    documents = spark.range(25).selectExpr("id", "0 AS user_id", "'t' AS title", "'p' AS source_path")
    places = spark.range(25).selectExpr("id AS document_id", "'default' AS model_name", "1D AS x", "2D AS y")
    members = spark.range(25).selectExpr("1 AS cluster_id", "id AS document_id", "0.5D AS membership_strength")
    assert all_pages(lambda n, at: serving.user_projections(documents, places, members, 0, limit=n, offset=at), 10) == 25
    last = serving.user_projections(documents, places, members, 0, limit=10, offset=20)
    assert [r["document_id"] for r in last.orderBy("document_id").collect()] == [20, 21, 22, 23, 24]


def test_only_stored_rows_under_keys_of_the_batch_travel(spark, monkeypatch):
    from trendloom.plans import ingest as plan

    landed = {"release": spark.createDataFrame([("acme", "r", "1", 7, "t", "n", "text")], "owner STRING, repo STRING, pos STRING, id BIGINT, tag_name STRING, name STRING, body STRING").selectExpr(
        "*", "'http://x' AS html_url", "named_struct('login', 'dev') AS author", "'2024' AS created_at", "'2024' AS published_at", "false AS prerelease", "false AS draft")}
    params = '{"owner": "acme", "repo": "r", "include_commits": false, "include_issues": false, "include_prs": false}'
    events = spark.range(40).selectExpr("concat('e', id) AS id", "id AS user_id", "'github' AS source", f"'{params}' AS source_params")
    # every user has stored the same many links, ten of them the one that comes again
    links = spark.range(500).selectExpr("concat('http://old/', id) AS source_path")
    store = spark.range(40).selectExpr("id AS user_id").crossJoin(links).unionByName(spark.range(10).selectExpr("id AS user_id", "'http://x' AS source_path"))
    written = {}

    def watched(df, label="stage", **options):
        written[label] = plan_cut(df, label, **options)
        return written[label]

    plan_cut = plan.cut_lineage
    monkeypatch.setattr(plan, "cut_lineage", watched)
    made = ingest_subscribed(events, landed, store, F.current_timestamp())
    assert written["known"].count() == 10
    assert made.documents.count() == 30
    assert sum(r["duplicates"] for r in made.stats.collect()) == 10


def test_items_are_written_with_each_value_once(spark, monkeypatch):
    from trendloom.plans import ingest as plan

    written, plan_cut = {}, plan.cut_lineage

    def watched(df, label="stage", **options):
        written[label] = plan_cut(df, label, **options)
        return written[label]

    monkeypatch.setattr(plan, "cut_lineage", watched)
    feed = _feed_rows(spark, [("f", 10, "same"), ("f", 9, "same"), ("g", 1, "same")])
    made = plan.ingest({"feed": feed}, _stored(spark), F.current_timestamp())
    assert not {"item_order", "doc_url"} & set(written["items"].columns)
    assert all(f.endswith(".zstd.parquet") for f in written["items"].inputFiles())
    assert [r["title"] for r in made.documents.collect()] == ["title f 9"]
