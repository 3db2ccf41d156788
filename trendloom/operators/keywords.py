"""Cluster keywords and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.functions.arrays import counted
from trendloom.operators.embedding import DEFAULT_DIM, hashed_vectors, token_bucket, token_sign
from trendloom.runtime import cut_lineage, require

N_KEYWORDS = 10
MAX_DF = 0.95
MIN_DF = 1
DIVERSITY = 0.5
KEYWORD_LENGTH = 255
NAME_LENGTH = 255
WEIGHT_DIGITS = 9


def cluster_texts(members: DataFrame, documents: DataFrame) -> DataFrame:
    """``cluster_id, document_id, raw_text`` of members with text."""
    texts = documents.select(F.col("id").alias("document_id"), "raw_text").where(~X.is_blank(F.col("raw_text")))
    return members.select("cluster_id", "document_id").join(texts, "document_id")


def term_counts(texts: DataFrame, stop_words: list[str], max_ngram: int = 2) -> DataFrame:
    """Occurrences of each 1..2-gram per document; ``texts`` has one row per member.

    They are counted inside the row, so no single occurrence is shuffled or held in a task's hash table.
    """
    terms = F.explode(counted(X.ngrams(F.col("raw_text"), stop_words, max_ngram)))
    return texts.select("cluster_id", "document_id", terms.alias("t")).select("cluster_id", "document_id", "t.term", "t.tf")


def document_frequency_filter(texts: DataFrame, counts: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``cluster_id, term, df, n`` of terms that are neither too rare nor too common.

    ``n`` counts the cluster's texts, also those without any term.
    """
    require(0 < max_df <= 1 and min_df >= 1, "min_df counts documents, max_df is a share")
    n = texts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("cluster_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "cluster_id").where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))


def keywords_tfidf(
    texts: DataFrame, stop_words: list[str], n_keywords: int = N_KEYWORDS, max_ngram: int = 2,
    min_df: int = MIN_DF, max_df: float = MAX_DF,
) -> DataFrame:
    """``cluster_id, keyword, weight, rank``: summed, row-normalised TF-IDF.

    Smoothed idf ``ln((1 + n) / (1 + df)) + 1``; each document's weights have
    length one; ties are alphabetical.
    """
    require(0 < max_df <= 1 and min_df >= 1, "min_df counts documents, max_df is a share")
    n = cut_lineage(texts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # document frequencies come from the rows they weigh, so texts are cut into terms once
    df = F.count(F.lit(1)).over(Window.partitionBy("cluster_id", "term"))
    counts = term_counts(texts, stop_words, max_ngram).withColumn("df", df).where(F.col("df") >= min_df)
    kept = counts.join(n, "cluster_id").where(F.col("df") <= F.col("n") * max_df)
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    weighed = kept.withColumn("w", F.col("tf") * idf)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster_id", "document_id")))
    summed = weighed.withColumn("w", F.col("w") / length).groupBy("cluster_id", "term").agg(F.sum("w").alias("weight"))
    best = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("weight", WEIGHT_DIGITS)), "term")
    ranked = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_keywords)
    return ranked.select("cluster_id", F.col("term").alias("keyword"), "weight", "rank")


def keywords_mmr(
    texts: DataFrame, stop_words: list[str], n_keywords: int = N_KEYWORDS, diversity: float = DIVERSITY, dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Terms close to the cluster's whole text and unlike each other.

    Every 1..2-gram of the cluster is a candidate.  Each greedy round is one
    aggregate over the candidates with a per-cluster maximum (combined on the
    map side); only the picks so far, at most ``n_keywords`` per cluster, go
    back to them.  ``weight`` is the similarity to the cluster.
    """
    require(0 <= diversity <= 1, "diversity must be in 0..1")
    words = texts.select("cluster_id", F.explode(X.tokens(F.col("raw_text"))).alias("token"))
    theme = hashed_vectors(words, ["cluster_id"], "token", dim).withColumnRenamed("embedding", "theme")
    terms = texts.select("cluster_id", F.explode(F.array_distinct(X.ngrams(F.col("raw_text"), stop_words))).alias("term")).distinct()
    parts = F.split("term", " ")
    scale = F.sqrt(F.size(parts).cast("double"))
    entries = F.transform(parts, lambda t: F.struct(token_bucket(t, dim).alias("b"), (token_sign(t) / scale).alias("v")))
    near = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["v"] * F.get("theme", x["b"]))
    candidates = terms.withColumn("e", entries).join(theme, "cluster_id").withColumn("sim", F.round(near, WEIGHT_DIGITS)).drop("theme")
    candidates = cut_lineage(candidates, "candidates")

    def overlap(a, b):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + F.when(x["b"] == y["b"], x["v"] * y["v"]).otherwise(0.0)))

    def best(df: DataFrame, score) -> DataFrame:
        # the largest score, then the alphabetically first term
        pick = F.struct("term", "e", "sim")
        order = F.struct((-F.round(score, WEIGHT_DIGITS)).alias("s"), F.col("term").alias("t"))
        return df.groupBy("cluster_id").agg(F.min_by(pick, order).alias("pick"))

    picks = best(candidates, F.col("sim")).select("cluster_id", F.array("pick").alias("picks"))
    for _ in range(n_keywords - 1):
        picks = cut_lineage(picks, "picks")
        open_ = candidates.join(picks, "cluster_id").where(~F.exists("picks", lambda p: p["term"] == F.col("term")))
        closest = F.array_max(F.transform("picks", lambda p: overlap(F.col("e"), p["e"])))
        fresh = best(open_, (1.0 - diversity) * F.col("sim") - diversity * closest)
        picks = picks.join(fresh, "cluster_id", "left").select(
            "cluster_id", F.concat("picks", F.when(F.col("pick").isNull(), F.slice("picks", 1, 0)).otherwise(F.array("pick"))).alias("picks")
        )
    rows = picks.select("cluster_id", F.posexplode("picks").alias("p", "k"))
    return rows.select("cluster_id", F.col("k.term").alias("keyword"), F.col("k.sim").alias("weight"), (F.col("p") + 1).alias("rank"))


def extract_keywords(texts: DataFrame, stop_words: list[str], method: str = "tfidf", n_keywords: int = N_KEYWORDS, **options) -> DataFrame:
    """``tfidf`` or ``keybert`` (similarity with diversity)."""
    methods = {"tfidf": keywords_tfidf, "keybert": keywords_mmr}
    require(method in methods, f"unknown keyword method {method!r}, use one of {sorted(methods)}")
    return methods[method](texts, stop_words, n_keywords, **options)


def stored_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.select(
        "cluster_id", F.substring("keyword", 1, KEYWORD_LENGTH).alias("keyword"), F.col("weight").cast("double").alias("weight")
    )


def cluster_name_fallback(keywords: DataFrame) -> DataFrame:
    """``cluster_id, name`` from the three best keywords."""
    top = keywords.where("rank <= 3").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    name = F.array_join(F.transform("k", lambda x: x["keyword"]), " • ")
    return top.select("cluster_id", X.truncate(name, NAME_LENGTH).alias("name"))
