"""Embedding, sentiment, keywords and insight assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AS_OF, DIM, STOP_WORDS
from checks.q_series import S_VIEWS, s_daily
from checks.registry import exploded_vector, query, r6, rounded
from trendloom.functions import text as X
from trendloom.functions.scores import combine_scores, confidence, sentiment_label, signed_score
from trendloom.operators import embedding, insight, keywords, sentiment

PATTERN = r"[\p{L}\p{N}_]+"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

# ---------------------------------------------------------------- embedding


def embedding_views(source: str) -> dict[str, str]:
    return {
        "e_tf": f"""SELECT id, t, 1 + ln(count(*)) AS w FROM (
                    SELECT id, unnest(regexp_extract_all(lower(raw_text), '{PATTERN}')) AS t FROM ({source})) GROUP BY 1, 2""",
        "e_bucket": f"""SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS b,
                        sum(w * CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM e_tf GROUP BY 1, 2""",
        "e_vec": "SELECT id AS document_id, b::INT AS dim, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM e_bucket",
    }


E_SQL = f"SELECT document_id, dim, {r6('v')} AS value FROM e_vec WHERE round(v, 6) <> 0"


def _vectors(df):
    return exploded_vector(df, "embedding", "document_id").where("value <> 0")


@query("e1_embed_documents", E_SQL, **embedding_views("SELECT * FROM d_documents"))
def _(v):
    return _vectors(embedding.embed_documents(v.documents(), DIM))


def _length_model():
    """Load-once hook for the check: two numbers per text."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" ") + 1] for t in texts], dtype=float)


@query("e2_embed_with_model", f"""
    SELECT id AS document_id, {r6("length(raw_text) / sqrt(pow(length(raw_text), 2) + pow(length(raw_text) - length(replace(raw_text, chr(32), '')) + 1, 2))")} AS first FROM d_documents""")
def _(v):
    out = embedding.embed_with_model(v.documents(), _length_model, 2, "lengths")
    return rounded(out.select("document_id", F.col("embedding")[0].alias("first")), "first")


@query("e3_embed_pending", E_SQL, **embedding_views("SELECT * FROM d_documents WHERE id NOT IN (SELECT document_id FROM d_embeddings)"))
def _(v):
    return _vectors(embedding.embed_pending(v.documents(), v.embeddings(), DIM))


# ---------------------------------------------------------------- sentiment

F_VIEWS = {
    "f_words": f"""
        SELECT id, least(length(raw_text) - length(replace(raw_text, '!', '')), 4) * 0.292 AS shout, i AS pos, tok[i] AS token
        FROM (SELECT id, raw_text, tok, unnest(range(1, len(tok) + 1)) AS i
              FROM (SELECT id, raw_text, regexp_extract_all(lower(raw_text), '{PATTERN}') AS tok FROM d_documents))""",
    "f_looked": """
        SELECT id, shout, valence,
               coalesce(lag(b, 1) OVER w, 0) + coalesce(lag(b, 2) OVER w, 0) * 0.95 + coalesce(lag(b, 3) OVER w, 0) * 0.9 AS boosted,
               coalesce(lag(g, 1) OVER w, 0) + coalesce(lag(g, 2) OVER w, 0) + coalesce(lag(g, 3) OVER w, 0) AS flips
        FROM (SELECT f.*, l.valence, CASE WHEN l.valence IS NULL THEN b.boost END AS b, CASE WHEN n.token IS NOT NULL THEN 1 END AS g
              FROM f_words f LEFT JOIN lexicon l USING (token) LEFT JOIN boosters b USING (token) LEFT JOIN negations n USING (token))
        WINDOW w AS (PARTITION BY id ORDER BY pos)""",
    "f_score": """
        SELECT d.id, coalesce(s.s, 0) + sign(coalesce(s.s, 0)) * coalesce(s.shout, 0) AS s
        FROM d_documents d LEFT JOIN (SELECT id, max(shout) AS shout, coalesce(sum((valence + sign(valence) * boosted) * pow(-0.74, flips)), 0) AS s
                                      FROM f_looked GROUP BY 1) s USING (id)""",
}


def _lexicon_scores(v):
    return sentiment.lexicon_sentiment(v.documents(), v.lexicon(), v.boosters(), v.negations())


@query("f1_lexicon_sentiment", f"SELECT id, {r6('greatest(-1, least(1, s / sqrt(s * s + 15)))')} AS vader FROM f_score", **F_VIEWS)
def _(v):
    return rounded(_lexicon_scores(v), "vader")


@query("f2_classifier_sentiment")
def _(v):
    labels = v.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = sentiment.train_classifier(v.documents(), labels)
    return rounded(sentiment.classifier_sentiment(v.documents(), model), "distilbert_score")


@query("f2_signed_score", f"""
    SELECT event_id, {r6("CASE event_type WHEN 'click' THEN -value / 500 WHEN 'view' THEN value / 500 ELSE 0 END")} AS signed FROM events""")
def _(v):
    label = F.expr("CASE event_type WHEN 'click' THEN 'negative' WHEN 'view' THEN 'LABEL_POS' ELSE 'neutral' END")
    return rounded(v.table("events").select("event_id", signed_score(label, F.col("value") / 500).alias("signed")), "signed")


@query("f3_combine_scores", f"SELECT document_id, {r6('combined_score')} AS combined FROM d_sentiments")
def _(v):
    scores = v.table("labels").selectExpr("doc_id AS document_id", "CASE quality WHEN 1 THEN 0.5D ELSE -0.5D END AS a", "CASE toxic WHEN 1 THEN -0.8D END AS b")
    return rounded(scores.select("document_id", combine_scores(F.col("a"), F.col("b")).alias("combined")), "combined")


@query("f4_analyze_sentiment", f"""
    SELECT id AS document_id, {r6('greatest(-1, least(1, s / sqrt(s * s + 15)))')} AS vader, CAST(NULL AS DOUBLE) AS distilbert_score,
           CAST(NULL AS VARCHAR) AS distilbert_label, {r6('greatest(-1, least(1, s / sqrt(s * s + 15)))')} AS combined_score
    FROM f_score WHERE id NOT IN (SELECT document_id FROM d_sentiments)""", **F_VIEWS)
def _(v):
    return rounded(sentiment.analyze_sentiment(v.documents(), v.sentiments(), [_lexicon_scores(v)]), "vader", "combined_score")


@query("f5_sentiment_label", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN 'unknown' WHEN round(value / 250 - 1, 1) >= 0.3 THEN 'positive'
           WHEN round(value / 250 - 1, 1) <= -0.3 THEN 'negative' ELSE 'neutral' END AS label FROM events""")
def _(v):
    score = F.when(F.col("event_type") != "click", F.round(F.col("value") / 250 - 1, 1))
    return v.table("events").select("event_id", sentiment_label(score).alias("label"))


# ---------------------------------------------------------------- keywords

H_VIEWS = {
    "t_words": f"""
        SELECT m.cluster_id, m.document_id, list_filter(regexp_extract_all(lower(d.raw_text), '{PATTERN}'), lambda t: t NOT IN ({STOP})) AS w
        FROM d_members m JOIN d_documents d ON d.id = m.document_id""",
    "t_counts": """
        SELECT cluster_id, document_id, term, count(*) AS tf FROM (
            SELECT cluster_id, document_id, unnest(w) AS term FROM t_words
            UNION ALL SELECT cluster_id, document_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t_words) GROUP BY 1, 2, 3""",
    "t_df": """
        SELECT c.cluster_id, c.term, count(*) AS df, n.n FROM t_counts c JOIN (SELECT cluster_id, count(*) AS n FROM t_words GROUP BY 1) n USING (cluster_id)
        GROUP BY c.cluster_id, c.term, n.n HAVING count(*) <= 0.95 * n.n""",
    "t_weights": """
        SELECT cluster_id, term, sum(w / len) AS weight FROM (
            SELECT cluster_id, document_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY cluster_id, document_id)) AS len FROM (
                SELECT c.*, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM t_counts c JOIN t_df USING (cluster_id, term))) GROUP BY 1, 2""",
    "t_keywords": """
        SELECT cluster_id, term AS keyword, weight, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank FROM t_weights) WHERE rank <= 10""",
}
KEYWORD_SQL = f"SELECT cluster_id, keyword, {r6('weight')} AS weight, CAST(rank AS INT) AS rank FROM t_keywords"


def _texts(v):
    return keywords.cluster_texts(v.members(), v.documents())


def _keywords(v):
    return keywords.keywords_tfidf(_texts(v), STOP_WORDS)


@query("h1_tokenize_ngrams", "SELECT cluster_id, document_id, term, tf FROM t_counts", **H_VIEWS)
def _(v):
    return keywords.term_counts(_texts(v), STOP_WORDS)


@query("h2_document_frequency_filter", "SELECT cluster_id, term, df, n FROM t_df", **H_VIEWS)
def _(v):
    return keywords.document_frequency_filter(_texts(v), keywords.term_counts(_texts(v), STOP_WORDS))


@query("h3_keywords_tfidf", KEYWORD_SQL, **H_VIEWS)
def _(v):
    return rounded(_keywords(v), "weight")


@query("h4_keywords_mmr")
def _(v):
    return rounded(keywords.keywords_mmr(_texts(v), STOP_WORDS, dim=DIM), "weight")


@query("h5_extract_keywords", KEYWORD_SQL, **H_VIEWS)
def _(v):
    return rounded(keywords.extract_keywords(_texts(v), STOP_WORDS, method="tfidf"), "weight")


@query("h6_store_keywords", f"SELECT cluster_id, substring(keyword, 1, 255) AS keyword, {r6('weight')} AS weight FROM t_keywords", **H_VIEWS)
def _(v):
    return rounded(keywords.stored_keywords(_keywords(v)), "weight")


@query("h7_cluster_name_fallback", """
    SELECT cluster_id, CASE WHEN length(n) > 255 THEN substring(n, 1, 252) || '...' ELSE n END AS name
    FROM (SELECT cluster_id, string_agg(keyword, ' • ' ORDER BY rank) AS n FROM t_keywords WHERE rank <= 3 GROUP BY 1)""", **H_VIEWS)
def _(v):
    return keywords.cluster_name_fallback(_keywords(v))


CLEAN = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(name, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g'), '\s+', ' ', 'g')), '')"""


@query("h8_clean_name", f"""
    SELECT conv_id, turn, CASE WHEN length(c) > 255 THEN substring(c, 1, 252) || '...' ELSE c END AS cut, CASE WHEN length(c) <= 255 THEN c END AS kept
    FROM (SELECT conv_id, turn, {CLEAN} AS c FROM (SELECT conv_id, turn, ' "' || text || E'" \\n' AS name FROM conversations))""")
def _(v):
    name = F.concat(F.lit(' "'), F.col("text"), F.lit('" \n'))
    return v.table("conversations").select(
        "conv_id", "turn", X.clean_name(name).alias("cut"), X.clean_name(name, overlong="reject").alias("kept")
    )


# ---------------------------------------------------------------- insights

SHORT = "CASE WHEN length(raw_text) > {0} THEN substring(raw_text, 1, {0} - 3) || '...' ELSE raw_text END"


def samples_sql(count: int, length: int) -> str:
    return (f"SELECT cluster_id, string_agg({SHORT.format(length)}, E'\\n---\\n' ORDER BY rank) AS samples "
            f"FROM i_samples WHERE rank <= {count} GROUP BY 1")


I_VIEWS = {
    **H_VIEWS, **S_VIEWS,
    "i_anoms": """SELECT cluster_id, summary_date AS anomaly_date, mention_count / 10.0::DOUBLE AS score,
                         CASE WHEN mention_count % 2 = 0 THEN 'volume_spike' ELSE 'sentiment_spike' END AS type FROM s_daily""",
    "i_members": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY membership_strength DESC NULLS LAST, document_id) AS rank
                    FROM d_members) WHERE rank <= 5""",
    "i_samples": "SELECT m.cluster_id, m.document_id, m.rank, d.raw_text FROM i_members m JOIN d_documents d ON d.id = m.document_id WHERE d.raw_text <> ''",
    "i_recent": """SELECT cluster_id, string_agg(type || ' anomaly on ' || strftime(anomaly_date, '%Y-%m-%d') || ' (score: ' || printf('%.2f', score) || ')', '; ' ORDER BY rank) AS anomaly_info
                   FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY anomaly_date DESC, type DESC) AS rank FROM i_anoms) WHERE rank <= 3 GROUP BY 1""",
    "i_words": "SELECT cluster_id, string_agg(keyword, ', ' ORDER BY rank) AS words, string_agg(keyword, ', ' ORDER BY rank) FILTER (rank <= 3) AS top FROM t_keywords GROUP BY 1",
    "i_label": """SELECT *, CASE WHEN avg_sentiment IS NULL THEN 'unknown' WHEN avg_sentiment >= 0.3 THEN 'positive' WHEN avg_sentiment <= -0.3 THEN 'negative' ELSE 'neutral' END AS mood,
                         coalesce(printf('%.2f', avg_sentiment), 'N/A') AS mood_score FROM d_clusters""",
    "i_cut300": samples_sql(4, 300),
    "i_cut200": samples_sql(3, 200),
    "i_text": """SELECT c.id AS cluster_id, c.document_count || ' documents about ' || w.top || '; overall sentiment is ' || c.mood || '. '
                        || coalesce(r.anomaly_info, 'No anomalies detected.') AS content
                 FROM i_label c JOIN i_words w ON w.cluster_id = c.id JOIN i_cut300 x ON x.cluster_id = c.id LEFT JOIN i_recent r ON r.cluster_id = c.id""",
    "i_scored": "SELECT *, len(string_split(content, ' ')) AS n FROM i_text",
    "i_rows": """SELECT cluster_id, content AS insight_text, CASE WHEN n >= 100 THEN 0.8::DOUBLE WHEN n < 30 THEN 0.6 ELSE 0.7 END AS confidence,
                        '{"model":"extractive","duration_ms":null,"eval_count":' || n || ',"template":"plain"}' AS llm_metadata FROM i_scored""",
}


def _anoms(v):
    kind = F.expr("CASE WHEN mention_count % 2 = 0 THEN 'volume_spike' ELSE 'sentiment_spike' END")
    return s_daily(v).select("cluster_id", F.col("summary_date").alias("anomaly_date"), (F.col("mention_count") / 10.0).alias("score"), kind.alias("type"))


def _context(v, clusters=None):
    return insight.insight_context(clusters if clusters is not None else v.clusters(), _keywords(v), v.members(), v.documents(), _anoms(v))


def _insights(v):
    return v.clusters().where("id % 4 = 0").select(F.col("id").alias("cluster_id"))


@query("l1_insight_targets", "SELECT id, user_id FROM d_clusters WHERE id % 4 <> 0")
def _(v):
    return insight.insight_targets(v.clusters(), _insights(v)).select("id", "user_id")


@query("l2_top_keywords", KEYWORD_SQL, **H_VIEWS)
def _(v):
    return rounded(insight.top_keywords(_keywords(v).drop("rank")), "weight").select("cluster_id", "keyword", "weight", "rank")


@query("l3_top_members", "SELECT cluster_id, document_id, CAST(rank AS INT) AS rank FROM i_members", **I_VIEWS)
def _(v):
    return insight.top_members(v.members()).select("cluster_id", "document_id", "rank")


@query("l4_document_samples", "SELECT cluster_id, string_agg(raw_text, '|' ORDER BY rank) AS samples FROM i_samples GROUP BY 1", **I_VIEWS)
def _(v):
    return insight.document_samples(v.members(), v.documents()).select("cluster_id", F.array_join("samples", "|").alias("samples"))


@query("l5_recent_anomalies", "SELECT cluster_id, anomaly_info FROM i_recent", **I_VIEWS)
def _(v):
    return insight.recent_anomalies(_anoms(v))


@query("l6_skip_incomplete", "SELECT cluster_id FROM i_text", **I_VIEWS)
def _(v):
    empty = v.clusters().withColumn("id", (F.col("id") + 1000).cast("int"))
    return _context(v, v.clusters().unionByName(empty)).select("cluster_id")


@query("l7_truncate_text", f"SELECT id, {SHORT.format(300)} AS short FROM d_documents")
def _(v):
    return v.documents().select("id", X.truncate(F.col("raw_text"), 300).alias("short"))


@query("l8_assemble_prompt", """
    SELECT c.id AS cluster_id, E'Summarise one theme in two sentences.\\nTerms: ' || w.words || E'\\nSize: ' || c.document_count || E'\\nMood: ' || c.mood
           || ' (' || c.mood_score || E')\\nUnusual days: ' || coalesce(r.anomaly_info, 'No anomalies detected.') || E'\\nExcerpts:\\n' || x.samples || E'\\n' AS prompt
    FROM i_label c JOIN i_words w ON w.cluster_id = c.id JOIN i_cut300 x ON x.cluster_id = c.id LEFT JOIN i_recent r ON r.cluster_id = c.id""", **I_VIEWS)
def _(v):
    return insight.assemble_prompt(_context(v)).select("cluster_id", "prompt")


@query("l9_assemble_name_prompt", """
    SELECT c.id AS cluster_id, E'Name this theme in two to four words.\\nTerms: ' || w.words || E'\\nSize: ' || c.document_count || E'\\nMood: ' || c.mood
           || E'\\nExcerpts:\\n' || x.samples || E'\\n' AS prompt
    FROM i_label c JOIN i_words w ON w.cluster_id = c.id JOIN i_cut200 x ON x.cluster_id = c.id""", **I_VIEWS)
def _(v):
    return insight.assemble_name_prompt(_context(v)).select("cluster_id", "prompt")


@query("l10_extractive_text", "SELECT cluster_id, content, CAST(n AS INT) AS eval_count FROM i_scored", **I_VIEWS)
def _(v):
    return insight.extractive_text(_context(v)).select("cluster_id", "content", "eval_count")


def _first_line_generator():
    """Load-once hook for the check: answers with the prompt's second line."""
    return lambda prompts: [p.split("\n")[1] for p in prompts]


@query("l10_generate_text", "SELECT cluster_id, 'Terms: ' || words AS content FROM i_words", **I_VIEWS)
def _(v):
    return insight.generate_text(insight.assemble_prompt(_context(v)), _first_line_generator).select("cluster_id", "content")


@query("l11_confidence", "SELECT event_id, CASE WHEN n >= 100 THEN 0.8::DOUBLE WHEN n > 0 AND n < 30 THEN 0.6 ELSE 0.7 END AS confidence FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN floor(value / 3)::BIGINT END AS n FROM events)")
def _(v):
    n = F.when(F.col("event_type") != "click", F.floor(F.col("value") / 3))
    return v.table("events").select("event_id", confidence(n).alias("confidence"))


def _made(v):
    return insight.insight_rows(insight.extractive_text(_context(v)), F.expr(f"timestamp'{AS_OF} 00:00:00'"), "extractive", "plain")


@query("l12_insight_rows", f"SELECT md5(concat_ws('|', cluster_id, '{AS_OF}T00:00:00.000000', 'plain')) AS id, cluster_id, insight_text, confidence, llm_metadata FROM i_rows", **I_VIEWS)
def _(v):
    return _made(v).drop("generated_at")


@query("l12_fill_names", """
    SELECT id, coalesce(name, CASE WHEN length(n) > 255 THEN substring(n, 1, 252) || '...' ELSE n END) AS name
    FROM d_clusters LEFT JOIN (SELECT cluster_id, 'Terms: ' || words AS n FROM i_words) ON cluster_id = id""", **I_VIEWS)
def _(v):
    named = insight.generate_text(insight.assemble_name_prompt(_context(v)), _first_line_generator)
    return insight.fill_names(v.clusters(), named).select("id", "name")


@query("l13_single_insight", "SELECT cluster_id, insight_text, 'completed' AS status FROM i_rows WHERE cluster_id = 3", **I_VIEWS)
def _(v):
    out = insight.single_insight(
        3, v.clusters(), _insights(v), _keywords(v), v.members(), v.documents(), _anoms(v), generated_at=F.expr(f"timestamp'{AS_OF} 00:00:00'")
    )
    return out.select("cluster_id", "insight_text", "status")
