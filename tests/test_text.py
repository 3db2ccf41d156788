"""Subscription rules, sentiment, keywords and prompts on hand-made inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import embedding, insight, keywords, sentiment
from trendloom.operators import subscriptions as S


def reasons(spark, *cases):
    rows = spark.createDataFrame([(i, s, json.dumps(p) if not isinstance(p, str) else p) for i, (s, p) in enumerate(cases)], "user_id INT, source STRING, source_params STRING")
    return [r.reason for r in S.validate_subscriptions(rows).orderBy("user_id").collect()]


def test_subscription_rules(spark):
    got = reasons(
        spark, ("rss", {"feed_urls": "HTTPS://a.b/c"}), ("rss", {"feed_urls": ["http://a", 3]}), ("rss", {"feed_urls": {"a": 1}}),
        ("hackernews", {}), ("hackernews", {"limit": 500}), ("hackernews", {"limit": True}), ("hackernews", {"limit_per_endpoint": 0, "limit": 501}),
        ("hackernews", {"endpoints": [], "endpoint": "askstories"}), ("hackernews", {"endpoint": 5}), ("github", {"repos": ["x"]}),
        ("github", {"repos": None, "owner": "o", "repo": "r"}), ("github", "[]"), ("github", "{broken"),
    )
    assert got == [
        None, "feed_urls[1] is not text", "feed_urls must be text or a list", None, None, None, "limit must be 1..500", None,
        "endpoints must be text or a list", "repos members must be objects", None, "parameters are not an object", "parameters are not an object",
    ]


def test_lexicon_rules(spark):
    docs = spark.createDataFrame(
        [(1, "good"), (2, "not good"), (3, "very good!"), (4, "plain words"), (5, " "), (6, "not a b c good"), (7, "bad")], "id INT, raw_text STRING"
    )
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "token STRING, valence DOUBLE")
    boosters = spark.createDataFrame([("very", 0.293)], "token STRING, boost DOUBLE")
    negations = spark.createDataFrame([("not",)], "token STRING")
    got = {r.id: r.vader for r in sentiment.lexicon_sentiment(docs, lexicon, boosters, negations).collect()}

    def scaled(s):
        return pytest.approx(s / (s * s + 15) ** 0.5)

    assert got == {1: scaled(2), 2: scaled(-1.48), 3: scaled(2.293 + 0.292), 4: 0.0, 6: scaled(2), 7: scaled(-2)}


def test_embedding_is_unit_length_and_independent_of_the_batch(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "three"), (3, "!!!")], "id INT, raw_text STRING")
    both = {r.document_id: r.embedding for r in embedding.embed_documents(docs, 32).collect()}
    alone = embedding.embed_documents(docs.where("id = 1"), 32).first().embedding
    assert set(both) == {1, 2} and both[1] == alone and np.linalg.norm(alone) == pytest.approx(1)


TEXTS = [("a", 1, "apple pie recipe"), ("a", 2, "apple tart and apple cake"), ("a", 3, "rocket launch window"), ("b", 4, "single text")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "cluster_id STRING, document_id INT, raw_text STRING")


def test_tfidf_gives_nothing_for_a_cluster_of_one_text(spark):
    got = keywords.keywords_tfidf(texts(spark), ["and"]).collect()
    assert {r.cluster_id for r in got} == {"a"} and [r.keyword for r in got if r["rank"] == 1] == ["apple"]
    assert "tart apple" in {r.term for r in keywords.term_counts(texts(spark), ["and"]).collect()}
    with pytest.raises(ValueError):
        keywords.extract_keywords(texts(spark), [], method="other")


def test_mmr_equals_a_greedy_loop(spark):
    dim = 64
    got = keywords.keywords_mmr(texts(spark), ["and"], n_keywords=5, dim=dim).where("cluster_id = 'a'").orderBy("rank").collect()

    def vectors(rows):
        return {r.document_id: np.array(r.embedding) for r in embedding.embed_documents(spark.createDataFrame(rows, "id STRING, raw_text STRING"), dim).collect()}

    theme = vectors([("all", " ".join(t for c, _, t in TEXTS if c == "a"))])["all"]
    terms = sorted({r.term for r in keywords.term_counts(texts(spark).where("cluster_id = 'a'"), ["and"]).collect()})
    v = vectors([(t, t) for t in terms])
    sim = {t: round(float(v[t] @ theme), 9) for t in terms}
    picked = [min(terms, key=lambda t: (-sim[t], t))]
    while len(picked) < 5:
        rest = [t for t in terms if t not in picked]
        picked.append(min(rest, key=lambda t: (-round(0.5 * sim[t] - 0.5 * max(float(v[t] @ v[p]) for p in picked), 9), t)))
    assert [r.keyword for r in got] == picked


def test_prompt_values_and_unknown_placeholder(spark):
    context = spark.createDataFrame(
        [("c", 0, None, ["k{x}"], ["t" * 301], None)],
        "cluster_id STRING, document_count INT, avg_sentiment DOUBLE, keywords ARRAY<STRING>, samples ARRAY<STRING>, anomaly_info STRING",
    )
    template = "{keywords}|{document_count}|{sentiment_label}|{sentiment_score}|{anomaly_info}|{document_samples}"
    prompt = insight.assemble_prompt(context, template).first().prompt
    assert prompt == "k{x}|Unknown|unknown|N/A|No anomalies detected.|" + "t" * 297 + "..."
    with pytest.raises(ValueError):
        insight.assemble_prompt(context, "{other}")


def test_single_insight_skips_without_keywords(spark):
    clusters = spark.createDataFrame([("c", "u", None, 2, 0.1)], "id STRING, user_id STRING, name STRING, document_count INT, avg_sentiment DOUBLE")
    none = spark.createDataFrame([], "cluster_id STRING, keyword STRING, weight DOUBLE")
    members = spark.createDataFrame([("c", "d", 1.0)], "cluster_id STRING, document_id STRING, membership_strength DOUBLE")
    docs = spark.createDataFrame([("d", "text")], "id STRING, raw_text STRING")
    anomalies = spark.createDataFrame([], "cluster_id STRING, anomaly_date DATE, type STRING, score DOUBLE")
    insights = spark.createDataFrame([], "cluster_id STRING")
    row = insight.single_insight("c", clusters, insights, none, members, docs, anomalies, generated_at=F.current_timestamp()).first()
    assert (row.status, row.insight_text) == ("skipped", None)


def test_terms_are_counted_inside_the_row(spark):
    rows = texts(spark).unionByName(spark.createDataFrame([("b", 5, "!!!"), ("b", 6, "go go, go stop")], "cluster_id STRING, document_id INT, raw_text STRING"))
    counts = keywords.term_counts(rows, ["and"])
    assert "HashAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {(r.document_id, r.term): r.tf for r in counts.where("cluster_id = 'b'").collect()}
    assert got == {(4, "single"): 1, (4, "text"): 1, (4, "single text"): 1, (6, "go"): 3, (6, "stop"): 1, (6, "go go"): 2, (6, "go stop"): 1}


def test_a_dotted_capital_does_not_cut_its_word(spark):
    row = spark.createDataFrame([("İstanbul AİLE straße ΟΔΟΣ",)], "t STRING").select(X.tokens(F.col("t")).alias("k")).first()
    assert row["k"] == ["istanbul", "aile", "straße", "οδος"]


def test_keywords_cut_texts_into_terms_once(spark):
    texts = spark.createDataFrame([(1, i, f"red apple number{i}") for i in range(5)] + [(2, 9, "blue pear"), (2, 10, "blue pear pie")], "cluster_id INT, document_id INT, raw_text STRING")
    found = keywords.keywords_tfidf(texts, [], min_df=2, max_df=1.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert {(r.cluster_id, r.keyword) for r in found.collect()} == {(1, "red"), (1, "apple"), (1, "red apple"), (2, "blue"), (2, "pear"), (2, "blue pear")}
