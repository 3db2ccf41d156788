"""Views derived from the driver's tables, once in Spark and once in SQL.

``VIEWS`` maps a view name to its DuckDB definition; the function of the same
name in ``Spark`` derives the same rows with DataFrames.  Raw payload views are
written as JSON lines to the shared folder and scanned back, so that the scans
are exercised too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions.scores import combine_scores
from trendloom.operators import clustering, timeseries
from trendloom.runtime import cut_lineage, shared_dir, spread
from trendloom.sources import landed

DIM = 64
AS_OF = "2024-01-31"
STOP_WORDS = ["the", "and", "of", "in", "to", "a", "de", "la", "le", "et", "der", "die", "und", "el", "que", "en"]

# Sentiment lexicon of the checks (an input table; any other would do).
LEXICON = [("than", 1.5), ("that", -1.0), ("der", 0.8), ("le", -0.6), ("el", 1.9), ("ation", 2.4), ("con", -2.1), ("sch", 0.5)]
BOOSTERS = [("la", 0.293), ("of", -0.293), ("die", 0.293)]
NEGATIONS = ["et", "in", "und"]

SUBSCRIPTION_PARAMS = {
    "rss": [
        '{"feed_urls": ["http://a.example/x", "https://b.example/y"]}',
        '{"feed_urls": "https://c.example/feed"}',
        '{"feed_urls": []}',
        '{"feed_urls": ["http://ok.example", "ftp://bad.example/z"]}',
        '{"feed_urls": ["http://ok.example", "  "]}',
        "{}",
        '{"feed_urls": ["nohost"]}',
        "{" + ", ".join(f'"k{i}": {i}' for i in range(51)) + "}",
    ],
    "hackernews": [
        '{"endpoints": ["topstories", " NewStories "], "limit": 50}',
        '{"endpoint": "beststories"}',
        '{"endpoints": ["bogus"]}',
        '{"limit": 0}',
        '{"limit_per_endpoint": 501}',
        '{"limit": "abc"}',
        '{"limit": "500"}',
        '{"endpoints": ["askstories", ""]}',
    ],
    "github": [
        '{"repos": [{"owner": "a", "repo": "b"}, {"owner": " c ", "repo": "d"}]}',
        '{"repos": {"owner": "x", "repo": "y"}}',
        '{"owner": "o", "repo": "r"}',
        '{"repos": []}',
        '{"repos": [{"owner": "a", "repo": "b"}, {"owner": "a", "repo": " "}]}',
        '{"owner": "o"}',
        '{"repos": "text"}',
        "{}",
    ],
    "mail": ["{}"] * 8,
}


def _params_case() -> str:
    whens = [
        f"WHEN c_custkey % 4 = {i} AND CAST(floor(c_custkey / 4) AS BIGINT) % 8 = {j} THEN '{text}'"
        for i, variants in enumerate(SUBSCRIPTION_PARAMS.values())
        for j, text in enumerate(variants)
    ]
    return "CASE " + " ".join(whens) + " END"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)


VIEWS: dict[str, str] = {
    "d_documents": """
        SELECT doc_id AS id, doc_id % 5 AS user_id, doc_id % 20 AS ingest_event_id, source,
               'doc://' || source || '/' || doc_id AS source_path, substring(text, 1, 80) AS title, text AS raw_text,
               TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) AS created_at, TIMESTAMP '2024-03-01' AS updated_at,
               doc_id % 3 = 0 AS processed, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS processed_at
        FROM documents""",
    "d_embeddings": "SELECT vec_id AS document_id, 'default' AS model_name, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    "d_vec_sums": f"""
        SELECT e.label AS cluster_id, i, avg(e.embedding[i]::DOUBLE) AS v
        FROM embeddings e, range(1, {DIM + 1}) r(i) GROUP BY 1, 2""",
    "d_centroids": "SELECT cluster_id, list(v ORDER BY i) AS centroid FROM d_vec_sums GROUP BY 1",
    "d_members": """
        SELECT e.label AS cluster_id, e.document_id,
               list_cosine_similarity(c.centroid, e.embedding) AS membership_strength
        FROM d_embeddings e JOIN d_centroids c ON e.label = c.cluster_id JOIN d_documents d ON d.id = e.document_id""",
    "d_sentiments": """
        SELECT doc_id AS document_id, a AS vader, b AS distilbert_score,
               CASE WHEN b IS NULL THEN NULL ELSE 'NEGATIVE' END AS distilbert_label,
               coalesce((a + b) / 2, a, b) AS combined_score
        FROM (SELECT doc_id, CASE quality WHEN 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS a,
                     CASE toxic WHEN 1 THEN -0.8::DOUBLE END AS b FROM labels)""",
    "d_clusters": """
        SELECT c.cluster_id AS id, c.cluster_id % 5 AS user_id, c.centroid, n.document_count, s.avg_sentiment,
               CASE WHEN c.cluster_id % 3 = 0 THEN NULL ELSE 'cluster ' || c.cluster_id END AS name,
               TIMESTAMP '2024-01-05' AS created_at, TIMESTAMP '2024-01-06' AS updated_at
        FROM d_centroids c
        JOIN (SELECT label, count(*) AS document_count FROM d_embeddings GROUP BY 1) n ON n.label = c.cluster_id
        LEFT JOIN (SELECT m.cluster_id, avg(combined_score) AS avg_sentiment FROM d_members m
                   JOIN d_sentiments USING (document_id) GROUP BY 1) s ON s.cluster_id = c.cluster_id""",
    "d_daily": """
        SELECT event_type AS cluster_id, CAST(ts AS DATE) AS summary_date, count(*) AS mention_count,
               avg(value) / 499.7 AS avg_sentiment
        FROM events GROUP BY 1, 2""",
    "d_series": """
        SELECT *, avg_sentiment - last_value(avg_sentiment IGNORE NULLS) OVER (
            PARTITION BY cluster_id ORDER BY summary_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS momentum
        FROM d_daily""",
    "d_events": """
        SELECT c_custkey AS id, c_custkey % 5 AS user_id, 'SRC' || c_custkey % 20 AS source,
               TIMESTAMP '2024-01-01' + to_hours((c_custkey % 700)::INT) AS started_at,
               CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status
        FROM customer""",
    "r_feed": """
        SELECT page_id, page_id % 5 AS user_id, 'feed' || page_id % 4 AS feed_url, page_id AS pos, link,
               CASE WHEN page_id % 22 = 0 THEN NULL WHEN link <> '' THEN link ELSE 'entry-' || page_id END AS id,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               CASE WHEN page_id % 3 <> 0 THEN html END AS summary,
               CASE WHEN page_id % 3 <> 1 THEN html END AS content,
               'day ' || page_id % 30 AS published,
               CASE WHEN page_id % 5 <> 0 THEN 'author ' || page_id % 7 END AS author,
               CASE page_id % 3 WHEN 1 THEN 'news' WHEN 2 THEN 'news, tech' ELSE '' END AS tags
        FROM (SELECT *, CASE WHEN page_id % 11 = 0 THEN '' ELSE regexp_replace(url, '[?#].*$', '') END AS link FROM pages)""",
    "r_stories": """
        SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'job' ELSE 'story' END AS type,
               event_type || ' ' || event_id AS title,
               CASE WHEN event_type <> 'click' THEN 'http://site' || event_id % 9 || '.example/' || event_id END AS url,
               CASE WHEN event_type = 'view' THEN props END AS text, user_id::VARCHAR AS by,
               floor(value)::BIGINT AS score, CASE WHEN event_id % 23 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS time,
               CASE WHEN event_id % 13 <> 0 THEN user_id % 7 END AS descendants,
               event_id % 17 = 0 AS deleted, event_id % 19 = 0 AS dead, event_id // 500 AS list_no
        FROM events""",
    "r_commits": """
        SELECT 'acme' AS owner, 'repo' || l_suppkey % 3 AS repo,
               lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_partkey::VARCHAR, 12, '0') || lpad(l_suppkey::VARCHAR, 12, '0')
                   || lpad(l_linenumber::VARCHAR, 2, '0') AS pos,
               md5(l_orderkey || '-' || l_linenumber) AS sha,
               CASE WHEN l_linenumber <> 5 THEN 'Change ' || l_returnflag || l_suppkey || chr(10) || 'status ' || l_linestatus END AS message,
               CASE WHEN l_partkey % 4 <> 0 THEN 'dev' || l_suppkey % 10 END AS name,
               CASE WHEN l_partkey % 3 <> 0 THEN 'dev' || l_suppkey % 10 || '@example.org' END AS email,
               strftime(l_shipdate, '%Y-%m-%d') AS date, floor(l_quantity)::BIGINT AS additions,
               l_linenumber::BIGINT AS deletions,
               CASE WHEN l_discount = 0 THEN 0 ELSE floor(l_quantity)::BIGINT + l_linenumber END AS total,
               l_linenumber * 2 AS n_files
        FROM lineitem""",
    "r_issues": """
        SELECT 'acme' AS owner, 'repo' || o_custkey % 3 AS repo, lpad(o_orderkey::VARCHAR, 12, '0') AS pos,
               o_orderkey AS number, CASE WHEN o_orderkey % 9 <> 0 THEN 'Order ' || o_orderpriority END AS title,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'Total ' || floor(o_totalprice)::BIGINT END AS body,
               CASE WHEN o_orderkey % 50 <> 0 THEN 'http://git.example/' || o_orderkey END AS html_url,
               CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state, c_name AS login, o_orderpriority AS label,
               strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderstatus, o_orderkey % 3 = 0 AS is_pull,
               CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS closed_at,
               CASE o_orderstatus WHEN 'O' THEN true WHEN 'P' THEN false END AS mergeable
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "r_releases": """
        SELECT 'acme' AS owner, 'repo' || p_partkey % 3 AS repo, lpad(p_partkey::VARCHAR, 12, '0') AS pos, p_partkey AS id,
               CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS tag_name,
               p_type AS body, CASE WHEN p_partkey % 50 <> 7 THEN 'http://git.example/r/' || p_partkey END AS html_url,
               'dev' || p_size AS login, 'size ' || p_size AS created_at, p_partkey % 3 = 0 AS prerelease, p_partkey % 2 = 0 AS draft
        FROM part""",
    "r_subscriptions": f"""
        SELECT c_custkey AS user_id,
               CASE c_custkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'hackernews' WHEN 2 THEN 'github' ELSE 'mail' END AS source,
               {_params_case()} AS source_params
        FROM customer""",
    "lexicon": f"SELECT * FROM (VALUES {_values(LEXICON)}) t(token, valence)",
    "boosters": f"SELECT * FROM (VALUES {_values(BOOSTERS)}) t(token, boost)",
    "negations": "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in NEGATIONS) + ") t(token)",
}


def sql(body: str, **views: str) -> str:
    """``body`` preceded by the views it uses, directly or through others."""
    known = {**VIEWS, **views}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body


class Spark:
    """The same views as DataFrames over the tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, build) -> DataFrame:
        """A derived table written once per query, as the engine's own tables are."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(build(), name)
        return self._stored[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def landed(self, df: DataFrame, name: str) -> str:
        path = shared_dir(self.spark, name)
        # compressed files are read whole by one task each, so their size is bounded
        df.write.option("compression", "gzip").option("maxRecordsPerFile", 250_000).json(path)
        return path

    def documents(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS id", "doc_id % 5 AS user_id", "doc_id % 20 AS ingest_event_id", "source",
            "concat('doc://', source, '/', doc_id) AS source_path", "substring(text, 1, 80) AS title", "text AS raw_text",
            "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 30 AS INT)) AS created_at", "timestamp'2024-03-01' AS updated_at",
            "doc_id % 3 = 0 AS processed", "CASE WHEN doc_id % 3 = 0 THEN timestamp'2024-02-01' END AS processed_at",
        )

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS document_id", "'default' AS model_name", "cast(embedding AS array<double>) AS embedding", "label"
        )

    def centroids(self) -> DataFrame:
        return self.stored("centroids", self._centroids)

    def members(self) -> DataFrame:
        return self.stored("members", self._members)

    def clusters(self) -> DataFrame:
        stored = self.stored("clusters", self._clusters)
        return stored.withColumn("created_at", F.expr("timestamp'2024-01-05'")).withColumn("updated_at", F.expr("timestamp'2024-01-06'"))

    def _centroids(self) -> DataFrame:
        return clustering.cluster_centroids(self.embeddings().withColumnRenamed("label", "cluster_id"), DIM)

    def _members(self) -> DataFrame:
        rows = self.embeddings().withColumnRenamed("label", "cluster_id")
        known = rows.join(self.documents().select(F.col("id").alias("document_id")), "document_id", "left_semi")
        return clustering.membership_strength(known, self.centroids()).select("cluster_id", "document_id", "membership_strength")

    def sentiments(self) -> DataFrame:
        scored = self.table("labels").selectExpr(
            "doc_id AS document_id", "CASE quality WHEN 1 THEN 0.5D ELSE -0.5D END AS vader",
            "CASE toxic WHEN 1 THEN -0.8D END AS distilbert_score",
            "CASE toxic WHEN 1 THEN 'NEGATIVE' END AS distilbert_label",
        )
        return scored.withColumn("combined_score", combine_scores(F.col("vader"), F.col("distilbert_score")))

    def _clusters(self) -> DataFrame:
        mean = clustering.cluster_avg_sentiment(self.members(), self.sentiments())
        return self.centroids().join(mean, "cluster_id", "left").selectExpr(
            "cluster_id AS id", "cluster_id % 5 AS user_id", "centroid", "document_count", "avg_sentiment",
            "CASE WHEN cluster_id % 3 = 0 THEN NULL ELSE concat('cluster ', cluster_id) END AS name",
        )

    def daily(self) -> DataFrame:
        return self.table("events").groupBy(
            F.col("event_type").alias("cluster_id"), F.to_date("ts").alias("summary_date")
        ).agg(F.count(F.lit(1)).alias("mention_count"), (F.avg("value") / 499.7).alias("avg_sentiment"))

    def series(self) -> DataFrame:
        return timeseries.add_momentum(self.daily())

    def events(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id", "c_custkey % 5 AS user_id", "concat('SRC', c_custkey % 20) AS source",
            "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(c_custkey % 700 AS INT)) AS started_at",
            "CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status",
        )

    # raw payloads ---------------------------------------------------------
    def feed_raw(self) -> DataFrame:
        linked = self.table("pages").selectExpr(
            "*", "CASE WHEN page_id % 11 = 0 THEN '' ELSE regexp_replace(url, '[?#].*$', '') END AS link"
        )
        return linked.selectExpr(
            "concat('feed', page_id % 4) AS feed_url", "page_id AS pos",
            "CASE WHEN page_id % 22 = 0 THEN NULL WHEN link <> '' THEN link ELSE concat('entry-', page_id) END AS id",
            "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title", "link",
            "CASE WHEN page_id % 3 <> 0 THEN html END AS summary",
            "CASE WHEN page_id % 3 <> 1 THEN array(named_struct('value', html)) END AS content",
            "concat('day ', page_id % 30) AS published",
            "CASE WHEN page_id % 5 <> 0 THEN concat('author ', page_id % 7) END AS author",
            "CASE page_id % 3 WHEN 1 THEN array(named_struct('term', 'news')) "
            "WHEN 2 THEN array(named_struct('term', 'news'), named_struct('term', 'tech')) END AS tags",
        )

    def feed_path(self) -> str:
        return self.landed(self.feed_raw(), "feed")

    def feed_xml(self) -> DataFrame:
        """One XML document a page, of as many entries as its id gives, landed as rows: one file each would cost more than its parsing."""
        entry = (
            "concat('<item>', CASE WHEN (page_id + i) % 3 = 0 THEN '' ELSE concat('<guid isPermaLink=\"false\">g', page_id, '-', i, '</guid>') END, "
            "'<title>', replace(replace(url, '&', '&amp;'), '<', '&lt;'), ' ', i, '</title><link>http://x.example/', page_id, '/', i, '</link>', "
            "'<description><![CDATA[<b>', i, '</b> & more]]></description>', CASE WHEN i % 2 = 0 THEN '<category>news</category><category>tech</category>' ELSE '' END, '</item>')"
        )
        head = "concat('<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>t</title><link>http://feed.example/', page_id, '</link>')"
        pages = spread(self.table("pages").select("page_id", "url"), "page_id")
        return self.stored("feed-xml", lambda: pages.selectExpr(
            "concat('feeds/', page_id, '.xml') AS path", f"concat({head}, array_join(transform(sequence(0, cast(page_id % 60 AS INT)), i -> {entry}), ''), '</channel></rss>') AS value"))

    def feed(self) -> DataFrame:
        """All landed entries, no per-feed cap."""
        raw = landed.scan_json(self.spark, self.feed_path(), schemas.FEED_ENTRY)
        return landed.feed_entry_fields(raw)

    def story_ids_path(self) -> str:
        lists = self.table("events").groupBy(F.expr("event_id div 500").alias("n")).agg(
            F.sort_array(F.collect_list("event_id")).alias("ids")
        )
        return self.landed(lists.selectExpr("concat('list', n) AS endpoint", "ids"), "story-ids")

    def stories_path(self) -> str:
        rows = self.table("events").selectExpr(
            "event_id AS id", "CASE event_type WHEN 'error' THEN 'job' ELSE 'story' END AS type",
            "concat(event_type, ' ', event_id) AS title",
            "CASE WHEN event_type <> 'click' THEN concat('http://site', event_id % 9, '.example/', event_id) END AS url",
            "CASE WHEN event_type = 'view' THEN props END AS text", "cast(user_id AS STRING) AS by",
            "cast(floor(value) AS BIGINT) AS score",
            "CASE WHEN event_id % 23 = 0 THEN 0 ELSE timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) END AS time",
            "CASE WHEN event_id % 13 <> 0 THEN user_id % 7 END AS descendants",
            "event_id % 17 = 0 AS deleted", "event_id % 19 = 0 AS dead",
        )
        return self.landed(rows, "stories")

    def commits_path(self) -> str:
        rows = self.table("lineitem").selectExpr(
            "'acme' AS owner", "concat('repo', l_suppkey % 3) AS repo",
            "concat(lpad(l_orderkey, 12, '0'), lpad(l_partkey, 12, '0'), lpad(l_suppkey, 12, '0'), lpad(l_linenumber, 2, '0')) AS pos",
            "md5(concat(l_orderkey, '-', l_linenumber)) AS sha",
            "named_struct('message', CASE WHEN l_linenumber <> 5 THEN concat('Change ', l_returnflag, l_suppkey, '\\n', 'status ', l_linestatus) END,"
            " 'author', named_struct('name', CASE WHEN l_partkey % 4 <> 0 THEN concat('dev', l_suppkey % 10) END,"
            " 'email', CASE WHEN l_partkey % 3 <> 0 THEN concat('dev', l_suppkey % 10, '@example.org') END,"
            " 'date', date_format(l_shipdate, 'yyyy-MM-dd'))) AS commit",
            "named_struct('additions', cast(floor(l_quantity) AS BIGINT), 'deletions', cast(l_linenumber AS BIGINT),"
            " 'total', CASE WHEN l_discount = 0 THEN 0 ELSE cast(floor(l_quantity) AS BIGINT) + l_linenumber END) AS stats",
            "transform(sequence(1, l_linenumber * 2), i -> named_struct('filename', concat('src/file_', i, '.py'))) AS files",
        )
        return self.landed(rows, "commits")

    def _orders(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_name")
        return self.table("orders").join(customers, F.expr("o_custkey = c_custkey"), "left")

    _TICKET = (
        "'acme' AS owner", "concat('repo', o_custkey % 3) AS repo", "lpad(o_orderkey, 12, '0') AS pos",
        "o_orderkey AS number", "CASE WHEN o_orderkey % 9 <> 0 THEN concat('Order ', o_orderpriority) END AS title",
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat('Total ', cast(floor(o_totalprice) AS BIGINT)) END AS body",
        "CASE WHEN o_orderkey % 50 <> 0 THEN concat('http://git.example/', o_orderkey) END AS html_url",
        "CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state", "named_struct('login', c_name) AS user",
        "array(named_struct('name', o_orderpriority)) AS labels", "date_format(o_orderdate, 'yyyy-MM-dd') AS created_at",
        "'later' AS updated_at",
    )

    def issues_path(self) -> str:
        rows = self._orders().selectExpr(
            *self._TICKET,
            "CASE WHEN o_orderstatus = 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS closed_at",
            "CASE WHEN o_orderkey % 3 = 0 THEN named_struct('url', 'x') END AS pull_request",
        )
        return self.landed(rows, "issues")

    def pulls_path(self) -> str:
        rows = self._orders().selectExpr(
            *self._TICKET,
            "CASE WHEN o_orderstatus = 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS merged_at",
            "CASE o_orderstatus WHEN 'O' THEN true WHEN 'P' THEN false END AS mergeable",
            "CASE WHEN o_orderkey % 6 <> 0 THEN named_struct('ref', 'main') END AS base",
            "named_struct('ref', concat('topic-', o_orderkey)) AS head",
        )
        return self.landed(rows, "pulls")

    def releases_path(self) -> str:
        rows = self.table("part").selectExpr(
            "'acme' AS owner", "concat('repo', p_partkey % 3) AS repo", "lpad(p_partkey, 12, '0') AS pos", "p_partkey AS id",
            "CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS tag_name", "CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name",
            "p_type AS body", "CASE WHEN p_partkey % 50 <> 7 THEN concat('http://git.example/r/', p_partkey) END AS html_url",
            "named_struct('login', concat('dev', p_size)) AS author", "concat('size ', p_size) AS created_at",
            "'later' AS published_at", "p_partkey % 3 = 0 AS prerelease", "p_partkey % 2 = 0 AS draft",
        )
        return self.landed(rows, "releases")

    def scan(self, path: str, ddl: str) -> DataFrame:
        return landed.scan_json(self.spark, path, ddl)

    def subscriptions(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS user_id",
            "CASE c_custkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'hackernews' WHEN 2 THEN 'github' ELSE 'mail' END AS source",
            f"{_params_case()} AS source_params",
        )

    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(LEXICON, "token STRING, valence DOUBLE")

    def boosters(self) -> DataFrame:
        return self.spark.createDataFrame(BOOSTERS, "token STRING, boost DOUBLE")

    def negations(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in NEGATIONS], "token STRING")
