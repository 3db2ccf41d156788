"""Registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import (
    decontamination, exact_dedup, html_extract, jaccard_join, lm_score, mixing, periodic_runs, preferences, secret_scan, sharding, substring_dedup, toxicity, whitening,
)
from trendloom.runtime import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_suffix_dedup", """
    WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    pieces AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS p FROM texts, unnest(range(0, (length(h) + 1999) // 2000)) AS u(c)),
    bytes AS (SELECT doc_id, 1000 * c + j AS i, substr(p, 2 * j + 1, 100) AS s FROM pieces, unnest(range(0, least(1000, length(p) // 2))) AS v(j)),
    strings AS (SELECT doc_id, i, s FROM bytes WHERE length(s) = 100),
    least AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
    hits AS (SELECT doc_id, i, i AS hit FROM strings JOIN least USING (s) WHERE doc_id > d),
    marked AS (
        SELECT doc_id, i, substr(s, 1, 2) AS x,
               coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) >= i - 49, false) AS gone
        FROM bytes LEFT JOIN hits USING (doc_id, i)),
    runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked),
    kept AS (
        SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS x
        FROM runs GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)""")
def _(spark, sf_dir):
    return substring_dedup.repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"), match=50)


@query("op2_decontamination")
def _(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.contaminated_documents(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return leaks.select("doc_id", "item_id", "item_tokens", "matched_tokens", "coverage", F.size("tiles").alias("n_tiles"))


@query("op3_lm_score")
def _(spark, sf_dir):
    ranks = Path(TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes()
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return lm_score.score_texts(documents(spark, sf_dir).select("doc_id", "text"), ranks, held_out)


@query("op4_mixing")
def _(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir).select("doc_id", "text", "source"), (1, 2, 3), max_repeats=3, block_words=32)


@query("op5_jaccard_join", """
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
        FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
    SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf_dir):
    return jaccard_join.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"), shingle=3, percent=90)


@query("op6_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.mark_exact_duplicates(docs, "doc_id", "text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_secret_scan")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    words = secret_scan.load_dictionary(f"{TOKENIZERS}/word_bpe_49k.json")
    findings = cut_lineage(secret_scan.find_candidates(docs, words), "findings")
    forest = secret_scan.train_forest(secret_scan.rule_labels(findings))
    found = secret_scan.filter_findings(findings, forest)
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


@query("op8_sharding")
def _(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_records(rows, "doc_id", [1.0] * 8, grown_weights=[1.0] * 9, order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _spans_sql(turns: str) -> str:
    size = "length(t.role) + length(t.text) + 13"
    at = f"coalesce(list_sum(list_transform({turns}[:i - 1], lambda t: {size})), 0)::BIGINT + length({turns}[i].role) + 5"
    return f"""array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),
        lambda i: concat({at}, '+', length({turns}[i].text) + 8)), ' ')"""


def _rendered_sql(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10))), ''), '')"


@query("op9_preferences", f"""
    WITH grouped AS (
        SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
        FROM conversations GROUP BY conv_id),
    marked AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last_reply FROM grouped),
    pairs AS (
        SELECT conv_id, CASE WHEN last_reply IS NULL THEN turns ELSE turns[:last_reply] END AS c,
               CASE WHEN last_reply IS NULL THEN turns ELSE list_concat(turns[:last_reply - 1], [{{'role': 'assistant', 'text': CASE WHEN last_reply > 1 THEN turns[last_reply - 1].text ELSE '' END}}]) END AS r
        FROM marked),
    common AS (
        SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) AS k FROM pairs),
    cut AS (SELECT conv_id, k, c[:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM common)
    SELECT conv_id, k::INTEGER AS prompt_turns, {_rendered_sql('p')} AS prompt, {_rendered_sql('c')} AS chosen, {_rendered_sql('r')} AS rejected,
           {_spans_sql('c')} AS chosen_spans, {_spans_sql('r')} AS rejected_spans
    FROM cut""")
def _(spark, sf_dir):
    turns = preferences.collect_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    pairs = preferences.format_preferences(preferences.echo_pairs(turns))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), " ")
    return pairs.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"))


def toxicity_model(spark, docs, labels):
    """Learns from the labelled rows outside the held-out fold."""
    train = labels.where(toxicity.hash_fold(F.col("doc_id")) != 2).select("doc_id", "toxic").join(docs.select("doc_id", "text"), "doc_id")
    return toxicity.train(train)


@query("op10_toxicity")
def _(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity_model(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model).select("doc_id", (toxicity.hash_fold(F.col("doc_id")) == 2).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


# Holds on pages whose article element has no boilerplate inside and blocks of <h1> and <p> only, as those of the given tables.
@query("op11_html_extract", """
    WITH articles AS (
        SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
    blocks AS (
        SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'),
            lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS b
        FROM articles),
    texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda t: t <> ''), chr(10)) AS text FROM blocks)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts""")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = html_extract.train_block_model(pages)
    return html_extract.extract_main_text(pages, model).select("page_id", "url", "text", "n_chars")


def planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of one document in ten, by the checksum of the id, whose words from a place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words, n = F.col("words"), F.size("words")
    g = F.floor(h / 10)
    spread = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    placed = spread.withColumn("from", F.when(n > 0, g % n).cast("int")).withColumn("every", (1 + F.floor((n - F.col("from")) / (3 + g % 8))).cast("int"))
    repeated = F.transform(words, lambda w, i: F.when(i < F.col("from"), w).otherwise(F.get(words, F.col("from") + F.pmod(i - F.col("from"), F.col("every")))))
    return placed.select("doc_id", F.when(F.col("from").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


# Each bit step of the checksum: half, with the fixed polynomial where the lowest bit was set.
@query("op12_periodic_runs", """
    WITH hashed AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
               xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                   lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS h
        FROM documents),
    placed AS (SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
    words AS (
        SELECT doc_id, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END AS w
        FROM placed, unnest(range(0, n)) AS u(i)),
    equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
    stretches AS (
        SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
    runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches GROUP BY doc_id, s, len),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS runs,
               first({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q) AS best
        FROM runs GROUP BY doc_id),
    dropped AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + q, s + len)) AS u(i)),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def _(spark, sf_dir):
    texts = planted_periods(documents(spark, sf_dir).select("doc_id", "text"))
    return periodic_runs.mark_periodic_runs(texts, digests=True).drop("text")


@query("op13_embedding_whitening")
def _(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit_whitening(table, components=32)
    rows = whitening.whiten(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]) if model.explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
