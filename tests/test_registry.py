"""Registered queries next to their SQL twins, the quick ones at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, canonical

QUICK = (
    "a1_scan_feed_entries", "a4_valid_stories", "b1_normalize_feed_entry", "b5_normalize_pull_request", "c4_validate_subscriptions", "d3_ingest_stats",
    "d5_upsert_latest", "f1_lexicon_sentiment", "g5_update_centroids", "h3_keywords_tfidf", "i5_merge_forecast", "j8_detect_anomalies",
    "j5_forest_against_closed_form", "l6_skip_incomplete", "n7_ann_all_lists", "o4_cluster_detail", "o7_list_anomalies", "a14_ingest_subscribed",
    "k6_trending_score", "l5_recent_anomalies", "m3_upsert_projections", "n4_search_documents", "o11_primary_cluster",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_every_twin_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 110


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_ranks_clusters(spark):
    rows = entry.entry(spark).collect()
    scores = [r.trending_score for r in rows]
    assert len(rows) == 10 and scores == sorted(scores, reverse=True)
