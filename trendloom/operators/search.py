"""Vector search: one query, a table of queries, and inverted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions import vectors as V
from trendloom.functions.text import is_blank, strip
from trendloom.operators.embedding import embed_documents
from trendloom.operators.neighbours import (
    BLOCK_ROWS, PIVOT_LISTS, RANK_DIGITS, _points, _top_k_kernel, nearest, rows_of_block, scan_blocks, squared_distances, with_pivot,
)
from trendloom.runtime import cut_lineage, require

DEFAULT_LIMIT = 10
LISTS = 100
MAX_LISTS = 4096
LIST_CELLS = 16
CELL_ROWS = 4


def _literal(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def search_embeddings(
    embeddings: DataFrame, vector: list[float], limit: int = DEFAULT_LIMIT, *, dim: int, model_name: str = "default",
    max_distance: float | None = None, documents: DataFrame | None = None, user_id=None,
) -> DataFrame:
    """``document_id, distance`` of the ``limit`` nearest vectors by cosine distance.

    The query's norm is folded into the plan as a literal; the ranking is a
    top-k over each partition followed by a merge, never a full sort.  With
    ``user_id`` only that owner's documents are ranked.  Ties go by id.
    """
    require(len(vector) == dim, f"query vector has width {len(vector)}, expected {dim}")
    require(limit >= 1, "limit must be positive")
    require(max_distance is None or 0 <= max_distance <= 2, "distance threshold must be in 0..2")
    length = float(np.linalg.norm(vector))
    require(length > 0, "query vector has no direction")
    rows = embeddings.where((F.col("model_name") == model_name) & (F.size("embedding") == dim))
    if user_id is not None:
        require(documents is not None, "owner scoping needs the documents table")
        mine = documents.where(F.col("user_id") == user_id).select(F.col("id").alias("document_id"))
        rows = rows.join(mine, "document_id", "left_semi")
    unit = _literal([x / length for x in vector])
    similarity = F.try_divide(V.dot(F.col("embedding"), unit), V.norm(F.col("embedding")))
    scored = rows.select("document_id", (1.0 - similarity).alias("distance")).where("distance IS NOT NULL")
    if max_distance is not None:
        scored = scored.where(F.col("distance") <= max_distance)
    return scored.orderBy(F.round("distance", RANK_DIGITS), "document_id").limit(limit)


def search_documents(embeddings: DataFrame, documents: DataFrame, vector: list[float], limit: int = DEFAULT_LIMIT, **options) -> DataFrame:
    """Document rows in rank order; the join sees only the ``limit`` hits."""
    hits = search_embeddings(embeddings, vector, limit, documents=documents, **options)
    found = hits.withColumnRenamed("document_id", "id").join(documents, "id")
    return found.orderBy(F.round("distance", RANK_DIGITS), "id")


def semantic_search(spark: SparkSession, text: str, embeddings: DataFrame, documents: DataFrame, limit: int = DEFAULT_LIMIT, *, dim: int, **options) -> DataFrame:
    """Embed a search text as documents are, then search with it."""
    require(bool(text and text.strip()), "search text must not be blank")
    one = spark.createDataFrame([(0, text)], "id INT, raw_text STRING").select("id", strip(F.col("raw_text")).alias("raw_text"))
    vector = embed_documents(one.where(~is_blank(F.col("raw_text"))), dim).first()
    require(vector is not None, "search text has no words")
    hits = search_documents(embeddings, documents, vector["embedding"], limit, dim=dim, **options)
    return hits.select("id", "title", "source_path", F.col("distance").alias("similarity_score"), "created_at")


def batch_search(queries: DataFrame, embeddings: DataFrame, limit: int = DEFAULT_LIMIT, *, group: str | None = None,
                 block_rows: int = BLOCK_ROWS, lists: int = PIVOT_LISTS) -> DataFrame:
    """Exact search for a whole table of ``(query_id, embedding)``."""
    found = nearest(
        queries, embeddings, limit, query_key="query_id", corpus_key="document_id", group=group, block_rows=block_rows, lists=lists
    )
    return found.select("query_id", F.col("neighbour_id").alias("document_id"), "rank", "distance")


# Inverted lists ---------------------------------------------------------------


def list_centres(embeddings: DataFrame, lists: int = LISTS, seed: int = 42, iterations: int = 5) -> np.ndarray:
    """Centres of the lists by k-means on unit vectors (a bounded, small matrix)."""
    require(1 <= lists <= MAX_LISTS, f"lists must be 1..{MAX_LISTS}")
    rows = embeddings.select(array_to_vector(V.unit(F.col("embedding"))).alias("features")).where("features IS NOT NULL")
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(rows)
    return np.array(model.clusterCenters())


def write_lists(embeddings: DataFrame, centres: np.ndarray, path: str, documents: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Store vectors by list, so that a search reads only the probed folders.

    With ``documents`` each vector carries its owner (``user_id``).  ``mode``
    "append" adds vectors to lists that stand already; their centres stay.
    """
    points = _points(embeddings, "document_id", "embedding", None, "cosine", [])
    placed = with_pivot(points, centres).select(F.col("id").alias("document_id"), F.col("vec").alias("embedding"), F.col("lst").alias("list_id"))
    if documents is not None:
        placed = placed.join(documents.select(F.col("id").alias("document_id"), "user_id"), "document_id", "left")
    placed.write.mode(mode).partitionBy("list_id").parquet(f"{path}/vectors")


def retire_vectors(documents: DataFrame, path: str) -> None:
    """Takes documents (column ``document_id``) out of the lists; vectors appended later under the same id stay out."""
    documents.select("document_id").distinct().write.mode("append").parquet(f"{path}/retired")


def _standing(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of all lists that have not been retired."""
    rows = spark.read.parquet(f"{path}/vectors")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/retired")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return rows
    return rows.join(spark.read.parquet(f"{path}/retired").distinct(), "document_id", "left_anti")


def ann_search(
    spark: SparkSession, path: str, centres: np.ndarray, vector: list[float], limit: int = DEFAULT_LIMIT, n_probe: int = 1, user_id=None, max_distance: float | None = None,
) -> DataFrame:
    """Approximate search: only the ``n_probe`` nearest lists are read, then an owner's vectors kept.

    The owner's filter comes after the probe, so an owner may get fewer than
    ``limit`` rows unless all lists are probed; then the result is that of the exact search.
    """
    require(1 <= n_probe, "n_probe must be positive")
    q = np.asarray(vector, dtype=float)
    q = q / np.linalg.norm(q)
    probes = [int(i) for i in squared_distances(q[None, :], centres)[0].argsort(kind="stable")[:n_probe]]
    rows = _standing(spark, path).where(F.col("list_id").isin(probes)).withColumn("model_name", F.lit("list"))
    if user_id is not None:
        require("user_id" in rows.columns, "the lists were written without owners")
        rows = rows.where(F.col("user_id") == user_id)
    return search_embeddings(rows, list(q), limit, dim=len(q), model_name="list", max_distance=max_distance)


def list_cells(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres of cells, list of each cell): lists cut finer by k-means, into ``LIST_CELLS`` cells each on average.

    A cell is in the list with the nearest centre, and cells are numbered list by list.
    """
    each = min(LIST_CELLS, MAX_LISTS // len(centres), points.count() // (len(centres) * CELL_ROWS))
    cells = list_centres(points.select(F.col("vec").alias("embedding")), len(centres) * each) if each > 1 else centres
    owner = squared_distances(cells, centres).argmin(1)
    order = np.argsort(owner, kind="stable")
    return cells[order], owner[order]


def _probed_kernel(limit: int):
    """The ``limit`` best of each query over the cells it probes; rows of other cells are not looked at."""
    best_of = _top_k_kernel(limit, "cosine", False)

    def kernel(q: pd.DataFrame, c: pd.DataFrame, qv: np.ndarray, cv: np.ndarray) -> pd.DataFrame:
        cell = c["cell"].to_numpy()
        probes = np.concatenate([np.asarray(p, dtype=np.int64) for p in q["probe"]])
        asks = np.repeat(np.arange(len(q)), [len(p) for p in q["probe"]])
        found = []
        for one in np.unique(cell):
            of, rows = asks[probes == one], np.flatnonzero(cell == one)
            if len(of):
                found.append(best_of(q.iloc[of], c.iloc[rows], qv[of], cv[rows]))
        if not found:
            return pd.DataFrame(columns=["id", "other", "d", "rank_value"])
        return pd.concat(found).sort_values(["rank_value", "other"]).groupby("id", sort=False).head(limit)

    return kernel


def ann_batch_search(queries: DataFrame, embeddings: DataFrame, centres: np.ndarray, limit: int = DEFAULT_LIMIT, n_probe: int = 1,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate search for a table of queries; each reads as much as ``n_probe`` lists of mean size hold.

    It reads the nearest cells of all lists (:func:`list_cells`) as long as their rows stay
    within that share, at least one cell, all of them if all lists are probed.
    """
    require(1 <= n_probe, "n_probe must be positive")
    points = cut_lineage(_points(embeddings, "document_id", "embedding", None, "cosine", []), "points")
    cells, list_of = list_cells(points, centres)
    lists = F.array(*[F.lit(int(i)) for i in list_of])
    corpus = cut_lineage(with_pivot(points, cells).withColumnRenamed("lst", "cell").drop("pd").withColumn("lst", F.get(lists, F.col("cell"))), "cells")
    size = np.zeros(len(cells), dtype=np.int64)
    for r in corpus.groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]
    share = int(size.sum()) if n_probe >= len(centres) else int(size.sum()) * n_probe // len(centres)
    q = _points(queries, "query_id", "embedding", None, "cosine", [])
    probed = T.StructType(q.schema.fields + [T.StructField("probe", T.ArrayType(T.IntegerType()))])

    def probe(batches):
        for b in batches:
            if b.empty:
                continue
            order = squared_distances(np.stack(b["vec"].to_numpy()), cells).argsort(axis=1, kind="stable").astype("int32")
            many = np.maximum((np.cumsum(size[order], axis=1) <= share).sum(axis=1), 1)
            yield b.assign(probe=[row[:n].tolist() for row, n in zip(order, many)])

    # a query goes to a list once, with the cells it probes there
    sent = cut_lineage(q.mapInPandas(probe, probed), "probes")
    visits = sent.withColumn("lst", F.explode(F.array_distinct(F.transform("probe", lambda i: F.get(lists, i)))))
    visits = visits.withColumn("probe", F.filter("probe", lambda i: F.get(lists, i) == F.col("lst")))
    schema = T.StructType([
        T.StructField("grp", T.IntegerType()), T.StructField("id", q.schema["id"].dataType),
        T.StructField("other", corpus.schema["id"].dataType), T.StructField("d", T.DoubleType()), T.StructField("rank_value", T.DoubleType()),
    ])
    # a query travels to each block of a list, a row to each block of queries: blocks grow with the table as in exact search
    rows = rows_of_block(int(size.sum()), cells.shape[1], block_rows)
    found = scan_blocks(visits, corpus, _probed_kernel(limit), schema, rows, part="cell")
    best = Window.partitionBy("id").orderBy("rank_value", "other")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select(F.col("id").alias("query_id"), F.col("other").alias("document_id"), "rank", (F.col("d") * F.col("d") / 2.0).alias("distance"))
