"""Schemas of landed payloads and of the engine's own tables (Spark DDL)."""

from __future__ import annotations

FEED_ENTRY = (
    "feed_url STRING, pos BIGINT, id STRING, title STRING, link STRING, summary STRING, "
    "content ARRAY<STRUCT<value: STRING>>, published STRING, author STRING, tags ARRAY<STRUCT<term: STRING>>"
)
STORY_IDS = "endpoint STRING, ids ARRAY<BIGINT>"
STORY_ITEM = (
    "id BIGINT, type STRING, title STRING, url STRING, text STRING, by STRING, score BIGINT, time BIGINT, "
    "descendants BIGINT, deleted BOOLEAN, dead BOOLEAN"
)
COMMIT = (
    "owner STRING, repo STRING, pos STRING, sha STRING, html_url STRING, "
    "commit STRUCT<message: STRING, author: STRUCT<name: STRING, email: STRING, date: STRING>>, "
    "stats STRUCT<additions: BIGINT, deletions: BIGINT, total: BIGINT>, files ARRAY<STRUCT<filename: STRING>>"
)
ISSUE = (
    "owner STRING, repo STRING, pos STRING, number BIGINT, title STRING, body STRING, html_url STRING, "
    "state STRING, user STRUCT<login: STRING>, labels ARRAY<STRUCT<name: STRING>>, created_at STRING, "
    "updated_at STRING, closed_at STRING, pull_request STRUCT<url: STRING>"
)
PULL_REQUEST = (
    "owner STRING, repo STRING, pos STRING, number BIGINT, title STRING, body STRING, html_url STRING, "
    "state STRING, user STRUCT<login: STRING>, labels ARRAY<STRUCT<name: STRING>>, created_at STRING, "
    "updated_at STRING, merged_at STRING, mergeable BOOLEAN, base STRUCT<ref: STRING>, head STRUCT<ref: STRING>"
)
RELEASE = (
    "owner STRING, repo STRING, pos STRING, id BIGINT, tag_name STRING, name STRING, body STRING, "
    "html_url STRING, author STRUCT<login: STRING>, created_at STRING, published_at STRING, "
    "prerelease BOOLEAN, draft BOOLEAN"
)

# One entry per table: DDL and key.  Ids are strings in production and any
# orderable type in tests; the operators never depend on the id type.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "users": ("id STRING, email STRING, name STRING, created_at TIMESTAMP", ("id",)),
    "ingest_events": (
        "id STRING, user_id STRING, source STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
        "status STRING, error_message STRING, updated_at TIMESTAMP",
        ("id",),
    ),
    "documents": (
        "id STRING, user_id STRING, ingest_event_id STRING, source_path STRING, title STRING, raw_text STRING, "
        "created_at TIMESTAMP, updated_at TIMESTAMP, processed BOOLEAN, processed_at TIMESTAMP",
        ("id",),
    ),
    "document_embeddings": (
        "id STRING, document_id STRING, model_name STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP",
        ("document_id", "model_name"),
    ),
    "document_sentiments": (
        "id STRING, document_id STRING, vader DOUBLE, distilbert_score DOUBLE, distilbert_label STRING, "
        "combined_score DOUBLE, created_at TIMESTAMP",
        ("document_id",),
    ),
    "clusters": (
        "id STRING, user_id STRING, centroid ARRAY<DOUBLE>, document_count BIGINT, avg_sentiment DOUBLE, "
        "trending_score DOUBLE, name STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
        ("id",),
    ),
    "cluster_members": (
        "cluster_id STRING, document_id STRING, membership_strength DOUBLE, created_at TIMESTAMP, updated_at TIMESTAMP",
        ("cluster_id", "document_id"),
    ),
    "keywords": ("id STRING, cluster_id STRING, keyword STRING, weight DOUBLE, created_at TIMESTAMP", ("cluster_id", "keyword")),
    "timeseries_summary": (
        "id STRING, cluster_id STRING, summary_date DATE, mention_count BIGINT, avg_sentiment DOUBLE, momentum DOUBLE, "
        "forecast_lower DOUBLE, forecast_upper DOUBLE, is_forecast BOOLEAN, created_at TIMESTAMP",
        ("cluster_id", "summary_date"),
    ),
    "anomalies": (
        "id STRING, cluster_id STRING, anomaly_date DATE, score DOUBLE, type STRING, direction INT, anomaly_metadata STRING, created_at TIMESTAMP",
        ("cluster_id", "anomaly_date", "type"),
    ),
    "insights": (
        "id STRING, cluster_id STRING, insight_text STRING, confidence DOUBLE, generated_at TIMESTAMP, llm_metadata STRING",
        ("id",),
    ),
    "umap_projections": (
        "id STRING, document_id STRING, model_name STRING, x DOUBLE, y DOUBLE, created_at TIMESTAMP",
        ("document_id", "model_name"),
    ),
    "user_ingestion_preferences": (
        "id STRING, user_id STRING, source STRING, source_params STRING, updated_at TIMESTAMP",
        ("user_id", "source"),
    ),
}
