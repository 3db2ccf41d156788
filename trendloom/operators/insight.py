"""From clusters to prompts and insight rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.functions.scores import confidence, sentiment_label
from trendloom.runtime import require

MAX_KEYWORDS = 10
MAX_MEMBERS = 5
MAX_ANOMALIES = 3
INSIGHT_SAMPLES, INSIGHT_SAMPLE_LENGTH = 4, 300
NAME_SAMPLES, NAME_SAMPLE_LENGTH = 3, 200
SAMPLE_SEPARATOR = "\n---\n"
NAME_LENGTH = 255

TEMPLATES = {
    "insight_template_brief": (
        "Summarise one theme in two sentences.\nTerms: {keywords}\nSize: {document_count}\n"
        "Mood: {sentiment_label} ({sentiment_score})\nUnusual days: {anomaly_info}\nExcerpts:\n{document_samples}\n"
    ),
    "insight_template": (
        "Write a short card about one theme for a monitoring page.\nTerms: {keywords}\nSize: {document_count}\n"
        "Mood: {sentiment_label} ({sentiment_score})\nUnusual days: {anomaly_info}\nExcerpts:\n{document_samples}\n"
        "Say what it is about, what changed, how the mood is, and what stands out.\n"
    ),
    "insight_template_detailed": (
        "Write a full paragraph about one theme for an analyst.\nTerms: {keywords}\nSize: {document_count}\n"
        "Mood: {sentiment_label} ({sentiment_score})\nUnusual days: {anomaly_info}\nExcerpts:\n{document_samples}\n"
        "Cover topic, development over time, mood, unusual days and open questions.\n"
    ),
    "cluster_name_template": (
        "Name this theme in two to four words.\nTerms: {keywords}\nSize: {document_count}\nMood: {sentiment_label}\n"
        "Excerpts:\n{document_samples}\n"
    ),
}


def insight_targets(clusters: DataFrame, insights: DataFrame, user_id=None, cluster_id=None) -> DataFrame:
    """Clusters without an insight, optionally of one owner or one id."""
    rows = clusters
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if cluster_id is not None:
        rows = rows.where(F.col("id") == cluster_id)
    return rows.join(insights.select(F.col("cluster_id").alias("id")), "id", "left_anti")


def _top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def top_keywords(keywords: DataFrame, limit: int = MAX_KEYWORDS) -> DataFrame:
    """Heaviest keywords first, missing weights last, ties alphabetical."""
    return _top(keywords, limit, F.desc_nulls_last("weight"), F.asc("keyword"))


def top_members(members: DataFrame, limit: int = MAX_MEMBERS) -> DataFrame:
    return _top(members, limit, F.desc_nulls_last("membership_strength"), F.asc("document_id"))


def document_samples(members: DataFrame, documents: DataFrame, limit: int = MAX_MEMBERS) -> DataFrame:
    """``cluster_id, samples``: texts of the strongest members, strongest first.

    The members are cut to ``limit`` per cluster before texts are fetched.
    """
    texts = documents.select(F.col("id").alias("document_id"), "raw_text").where(X.present(F.col("raw_text")))
    found = top_members(members, limit).select("cluster_id", "document_id", "rank").join(texts, "document_id")
    gathered = found.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "raw_text"))).alias("s"))
    return gathered.select("cluster_id", F.transform("s", lambda x: x["raw_text"]).alias("samples"))


def recent_anomalies(anomalies: DataFrame, limit: int = MAX_ANOMALIES) -> DataFrame:
    """``cluster_id, anomaly_info``: the latest anomalies as one line."""
    latest = _top(anomalies, limit, F.desc("anomaly_date"), F.desc("type"))
    day = F.date_format("anomaly_date", "yyyy-MM-dd")
    line = F.concat("type", F.lit(" anomaly on "), day, F.lit(" (score: "), X.two_decimals(F.col("score")), F.lit(")"))
    gathered = latest.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("a"))
    return gathered.select("cluster_id", F.array_join(F.transform("a", lambda x: x["line"]), "; ").alias("anomaly_info"))


def insight_context(clusters: DataFrame, keywords: DataFrame, members: DataFrame, documents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per cluster with everything a prompt needs.

    Clusters without keywords or without sample texts are skipped.
    """
    words = top_keywords(keywords).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    words = words.select("cluster_id", F.transform("k", lambda x: x["keyword"]).alias("keywords"))
    base = clusters.select(F.col("id").alias("cluster_id"), "name", "document_count", "avg_sentiment")
    return (
        base.join(words, "cluster_id")
        .join(document_samples(members, documents), "cluster_id")
        .join(recent_anomalies(anomalies), "cluster_id", "left")
    )


def fill(template: str, values: dict[str, Column]) -> Column:
    """Template with its ``{placeholders}`` replaced.

    The template is split when the plan is built, so braces inside inserted
    texts stay as they are.
    """
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(values)
    require(not unknown, f"template asks for unknown values: {sorted(unknown)}")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _values(samples: int, length: int) -> dict[str, Column]:
    count = F.col("document_count")
    cut = F.transform(F.slice("samples", 1, samples), lambda s: X.truncate(s, length))
    return {
        "keywords": F.array_join(F.slice("keywords", 1, MAX_KEYWORDS), ", "),
        "document_samples": F.array_join(cut, SAMPLE_SEPARATOR),
        "sentiment_label": sentiment_label(F.col("avg_sentiment")),
        "sentiment_score": F.coalesce(X.two_decimals(F.col("avg_sentiment")), F.lit("N/A")),
        "document_count": F.when(F.coalesce(count, F.lit(0)) == 0, "Unknown").otherwise(count.cast("string")),
        "anomaly_info": F.coalesce(F.nullif(F.col("anomaly_info"), F.lit("")), F.lit("No anomalies detected.")),
    }


def assemble_prompt(context: DataFrame, template: str = TEMPLATES["insight_template_brief"]) -> DataFrame:
    values = _values(INSIGHT_SAMPLES, INSIGHT_SAMPLE_LENGTH)
    return context.withColumn("prompt", fill(template, values))


def assemble_name_prompt(context: DataFrame, template: str = TEMPLATES["cluster_name_template"]) -> DataFrame:
    values = _values(NAME_SAMPLES, NAME_SAMPLE_LENGTH)
    return context.withColumn("prompt", fill(template, values))


def extractive_text(context: DataFrame) -> DataFrame:
    """A plain sentence per cluster out of its own columns, with its token count."""
    v = _values(0, 4)
    text = F.concat(
        v["document_count"], F.lit(" documents about "), F.array_join(F.slice("keywords", 1, 3), ", "),
        F.lit("; overall sentiment is "), v["sentiment_label"], F.lit(". "), v["anomaly_info"],
    )
    return context.withColumn("content", text).withColumn("eval_count", F.size(F.split(F.col("content"), " ")))


Generator = Callable[[list[str]], list[str]]


def generate_text(prompts: DataFrame, load: Callable[[], Generator], key: str = "cluster_id") -> DataFrame:
    """``content`` and ``eval_count`` from a caller's batch generator.

    ``load`` runs once per Python worker task; prompts arrive in Arrow batches.
    """
    rows = prompts.select(key, "prompt")
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for b in batches:
            if b.empty:
                continue
            texts = list(generate(b["prompt"].tolist()))
            yield pd.DataFrame({key: b[key], "content": texts, "eval_count": [len(t.split()) for t in texts]})

    return rows.mapInPandas(run, f"{key} {key_type}, content STRING, eval_count INT")


def insight_rows(generated: DataFrame, generated_at: Column, model: str, template_name: str) -> DataFrame:
    """Insight table rows out of generated texts; the id depends on cluster, time and template alone."""
    duration = F.col("duration_ms") if "duration_ms" in generated.columns else F.lit(None).cast("bigint")
    meta = F.struct(
        F.lit(model).alias("model"), duration.alias("duration_ms"), F.col("eval_count").alias("eval_count"), F.lit(template_name).alias("template")
    )
    made = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return generated.select(
        F.md5(F.concat_ws("|", F.col("cluster_id").cast("string"), made, F.lit(template_name))).alias("id"),
        "cluster_id", X.strip(F.col("content")).alias("insight_text"), confidence(F.col("eval_count")).alias("confidence"),
        generated_at.alias("generated_at"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("llm_metadata"),
    )


def fill_names(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Give nameless clusters the cleaned generated name; others keep theirs."""
    fresh = names.select(F.col("cluster_id").alias("id"), X.clean_name(F.col("content"), NAME_LENGTH).alias("_name"))
    kept = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("_name"))
    return clusters.join(fresh, "id", "left").withColumn("name", kept).drop("_name")


def single_insight(cluster_id, clusters: DataFrame, insights: DataFrame, *context_tables: DataFrame, generated_at: Column) -> DataFrame:
    """Insight of one cluster with a status column; no text when it is skipped."""
    wanted = clusters.where(F.col("id") == cluster_id)
    made = insight_rows(
        extractive_text(insight_context(insight_targets(wanted, insights), *context_tables)), generated_at, "extractive", "extractive"
    )
    status = F.when(F.col("insight_text").isNotNull(), "completed").otherwise("skipped")
    return wanted.select(F.col("id").alias("cluster_id")).join(made, "cluster_id", "left").withColumn("status", status)
