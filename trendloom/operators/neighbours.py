"""Exact nearest neighbours as a partitioned join.

Neither a cross join nor a table of all pairs is ever made.  Rows are laid out
in *cells* around a fixed number of pivot vectors, neighbouring cells form
*lists* (groups small enough are one list), lists are split into blocks of
bounded size, and one task compares one block of queries with one block of
corpus rows by matrix product, handing on only the ``k`` best per query.

The search runs in two passes.  Pass one looks into each query's own list and
yields an upper bound on its k-th distance.  Pass two visits only those other
lists with a cell that the triangle inequality cannot rule out
(``d(q, pivot) - radius <= bound``), so the result is exact, and hot lists are
split both by query and by corpus block.

Where nothing is ruled out every row meets every list, so blocks grow with the
largest group: there are about ``GROUP_BLOCKS`` of them, and a row travels that
often, until a block holds ``BLOCK_BYTES`` of vectors.  A task multiplies them
in pieces of ``PIECE_CELLS`` distances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.functions import vectors as V
from trendloom.runtime import cut_lineage, require

BLOCK_ROWS = 2048
GROUP_BLOCKS = 8
BLOCK_BYTES = 32_000_000
PIECE_CELLS = 4_000_000
PIVOT_LISTS = 128
MAX_PIVOTS = 1024
RANK_DIGITS = 9
_EPS = 1e-7

#: (queries, corpus rows, their vectors as one array each) -> found rows
Kernel = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]


def _points(df: DataFrame, key: str, vec: str, group: str | None, metric: str, extra: list[str]) -> DataFrame:
    """(grp, id, vec) with rows dropped that have no usable vector."""
    v = V.unit(F.col(vec)) if metric == "cosine" else V.as_double(F.col(vec))
    grp = F.col(group) if group else F.lit(0)
    out = df.select(grp.alias("grp"), F.col(key).alias("id"), v.alias("vec"), *extra)
    return out.where("vec IS NOT NULL AND size(vec) > 0 AND grp IS NOT NULL")


def squared_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    gram = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
    return np.maximum(gram, 0.0)


def exact_distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distance without the cancellation of the gram form."""
    diff = q - c
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _top_k_kernel(k: int, metric: str, exclude_self: bool) -> Kernel:
    def kernel(q: pd.DataFrame, c: pd.DataFrame, qv: np.ndarray, cv: np.ndarray) -> pd.DataFrame:
        qid, cid = q["id"].to_numpy(), c["id"].to_numpy()
        own, other = np.einsum("ij,ij->i", qv, qv), np.einsum("ij,ij->i", cv, cv)
        # products of long vectors lose digits; what they let through is measured exactly
        slack = _EPS + 1e-13 * (own + other.max())
        bound = q["bound"].to_numpy(float) if "bound" in q else np.full(len(q), np.inf)
        if np.isfinite(bound).all():
            # |q - c|^2 <= bound^2, halved and without the part that is the same for all of a query
            near = qv @ cv.T
            near -= other / 2.0
            rows, cols = np.divmod(np.flatnonzero(near >= ((own - bound * bound - slack) / 2.0)[:, None]), len(cid))
            if exclude_self:
                apart = qid[rows] != cid[cols]
                rows, cols = rows[apart], cols[apart]
        else:
            d2 = squared_distances(qv, cv)
            if exclude_self:
                d2[qid[:, None] == cid[None, :]] = np.inf
            kk = min(k, d2.shape[1])
            kth = np.minimum(np.partition(d2, kk - 1, axis=1)[:, kk - 1], bound * bound)
            rows, cols = np.nonzero((d2 <= (kth + slack)[:, None]) & np.isfinite(d2))
        dist = exact_distance(qv[rows], cv[cols])
        rank_value = np.round(dist * dist / 2.0 if metric == "cosine" else dist, RANK_DIGITS)
        order = np.lexsort((cid[cols], rank_value, rows))
        rows, cols, dist, rank_value = rows[order], cols[order], dist[order], rank_value[order]
        starts = np.searchsorted(rows, rows, side="left")
        keep = (np.arange(len(rows)) - starts) < k
        rows, cols = rows[keep], cols[keep]
        out = {
            "id": qid[rows],
            "other": cid[cols],
            "d": dist[keep],
            "rank_value": rank_value[keep],
        }
        return pd.DataFrame(out)

    return kernel


def rows_of_block(largest: int, dim: int, block_rows: int) -> int:
    """Rows of a block where the largest group has ``largest`` rows; see above."""
    return max(block_rows, min(-(-largest // GROUP_BLOCKS), BLOCK_BYTES // (8 * (dim or 1))))


def scan_blocks(visits: DataFrame, corpus: DataFrame, kernel: Kernel, schema: T.StructType, block_rows: int, part: str | None = None) -> DataFrame:
    """Run ``kernel`` on (query block, corpus block) pairs of the same list.

    ``visits`` has (grp, lst, id, vec, ...), ``corpus`` the same plus nothing
    else required.  Both sides are cut into blocks of about ``block_rows`` rows,
    so no task ever holds a whole hot list.  A kernel that compares with the corpus rows of one value
    of column ``part`` at a time is given more queries at once.
    """
    in_blocks = F.greatest(F.round(F.count(F.lit(1)) / block_rows), F.lit(1)).cast("int")
    n_q = visits.groupBy("grp", "lst").agg(in_blocks.alias("nq"))
    n_c = corpus.groupBy("grp", "lst").agg(in_blocks.alias("nc"))
    # a table of its own size: the planner sends it out, so that vectors are not dealt once more for this join
    sizes = cut_lineage(n_q.join(n_c, ["grp", "lst"]), "sizes")

    def blocks(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        # fresh column identities: both sides may come from one table
        fresh = side.select(*[F.col(c).alias(c) for c in side.columns])
        return (
            fresh.join(sizes, ["grp", "lst"])
            .withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("nq", "nc")
        )

    left = blocks(visits, "qb", "nq", "cb", "nc").groupBy("grp", "lst", "qb", "cb")
    right = blocks(corpus, "cb", "nc", "qb", "nq").groupBy("grp", "lst", "qb", "cb")
    names = [f.name for f in schema.fields if f.name != "grp"]

    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=["grp", *names])
        qv, cv = np.stack(q["vec"].to_numpy()), np.stack(c["vec"].to_numpy())
        wide = len(c) if part is None else int(c[part].value_counts().max())
        step = max(1, PIECE_CELLS // wide)
        found = pd.concat([kernel(q.iloc[i : i + step], c, qv[i : i + step], cv) for i in range(0, len(q), step)], ignore_index=True)
        found.insert(0, "grp", key[0])
        return found

    return left.cogroup(right).applyInPandas(run, schema)


def choose_pivots(points: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors taken by smallest id hash: a fixed-size, repeatable sample."""
    require(1 <= n <= MAX_PIVOTS, f"pivot lists must be 1..{MAX_PIVOTS}")
    rows = points.orderBy(F.xxhash64("id"), "id").select("vec").limit(n).collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def in_a_row(pivots: np.ndarray) -> np.ndarray:
    """The pivots ordered so that each is followed by the nearest one still left."""
    left, order = np.ones(len(pivots), dtype=bool), [0]
    left[0] = False
    while left.any():
        gaps = np.where(left, squared_distances(pivots[order[-1:]], pivots)[0], np.inf)
        order.append(int(gaps.argmin()))
        left[order[-1]] = False
    return pivots[order]


def with_pivot(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``lst`` and the distance to it ``pd``."""
    schema = T.StructType(points.schema.fields + [T.StructField("lst", T.IntegerType()), T.StructField("pd", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            v = np.stack(b["vec"].to_numpy())
            nearest = squared_distances(v, pivots).argmin(1)
            yield b.assign(lst=nearest.astype("int32"), pd=exact_distance(v, pivots[nearest]))

    return points.mapInPandas(assign, schema)


class Layout:
    """Corpus rows placed in lists, with what is needed to rule lists out."""

    def __init__(self, corpus: DataFrame, block_rows: int, lists: int):
        sizes = corpus.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
        facts = sizes.agg(F.max("n").alias("n"), F.max("dim").alias("dim")).first()
        largest = facts["n"] or 0
        self.block_rows = rows_of_block(largest, facts["dim"], block_rows)
        self.split = largest > block_rows
        if not self.split:
            self.corpus = corpus.withColumn("lst", F.lit(-1))
            return
        self.big = cut_lineage(sizes.where(F.col("n") > block_rows).select("grp"), "big")
        self.pivots = in_a_row(choose_pivots(corpus, lists))
        celled = cut_lineage(self._in_cells(corpus), "cells")
        # cells follow each other as their pivots do; a list takes the next ones until it holds a block
        before = Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        per_cell = celled.groupBy("grp", "cell").agg(F.max("pd").alias("radius"), F.count(F.lit(1)).alias("n"))
        filled = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / self.block_rows).cast("int")
        per_cell = per_cell.withColumn("lst", F.when(F.col("cell") < 0, F.lit(-1)).otherwise(filled))
        self.cells = cut_lineage(per_cell.select("grp", "cell", "lst", "radius"), "directory")
        self.corpus = self._in_lists(celled)
        self.directory = self.cells.groupBy("grp").agg(F.collect_list(F.struct("cell", "lst", "radius")).alias("dir"))

    def _in_cells(self, points: DataFrame) -> DataFrame:
        """The cell of each row; rows of small groups share cell -1."""
        tagged = with_pivot(points, self.pivots).withColumnRenamed("lst", "cell").join(self.big.withColumn("is_big", F.lit(True)), "grp", "left")
        return tagged.withColumn("cell", F.when(F.col("is_big"), F.col("cell")).otherwise(F.lit(-1))).drop("is_big")

    def _in_lists(self, celled: DataFrame) -> DataFrame:
        """A cell without corpus rows is in list -2, which holds nothing."""
        own = self.cells.select("grp", "cell", "lst")
        return celled.join(own, ["grp", "cell"], "left").withColumn("lst", F.coalesce("lst", F.lit(-2))).drop("cell", "pd")

    def place(self, points: DataFrame) -> DataFrame:
        """Home list of each row; rows of small groups share list -1."""
        return self._in_lists(self._in_cells(points)) if self.split else points.withColumn("lst", F.lit(-1))

    def other_lists(self, bounded: DataFrame) -> DataFrame:
        """One row per (query, list that may hold something closer than ``bound``)."""
        with_dir = bounded.join(self.directory, "grp").select(
            "*", F.col("dir.cell").alias("_cs"), F.col("dir.lst").alias("_ls"), F.col("dir.radius").alias("_rs")
        ).drop("dir")
        out = T.StructType(bounded.schema.fields + [T.StructField("probe", T.ArrayType(T.IntegerType()))])
        pivots, names = self.pivots, [f.name for f in out.fields]

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                to_pivot = np.sqrt(squared_distances(np.stack(b["vec"].to_numpy()), pivots))
                picked = []
                for row, home, bound, cs, ls, rs in zip(to_pivot, b["lst"], b["bound"], b["_cs"], b["_ls"], b["_rs"]):
                    cs, ls = np.asarray(cs), np.asarray(ls)
                    # list -1 holds a whole small group, which pass one has seen
                    near = (ls >= 0) & (ls != home) & (row[cs] - np.asarray(rs) <= bound + 1e-6)
                    picked.append(np.unique(ls[near]).tolist())
                yield b.assign(probe=picked)[names]

        # vectors are written once and multiplied when they are read again
        hits = cut_lineage(with_dir.mapInPandas(probe, out), "visits")
        return hits.withColumn("lst", F.explode("probe")).drop("probe")


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_key: str,
    corpus_key: str,
    query_vec: str = "embedding",
    corpus_vec: str = "embedding",
    group: str | None = None,
    metric: str = "cosine",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    lists: int = PIVOT_LISTS,
) -> DataFrame:
    """The ``k`` corpus rows nearest to each query row, exactly.

    Returns ``grp, query_id, neighbour_id, rank, distance``.  ``distance`` is
    ``1 - cosine`` or Euclidean.  Order is by distance rounded to nine places,
    then by neighbour id, so equal vectors rank the same way everywhere.  With
    ``group`` only rows of the same group are compared.  Rows without a vector,
    and zero vectors under cosine, take no part.
    """
    require(k >= 1, "k must be at least 1")
    require(metric in ("cosine", "euclidean"), "metric must be cosine or euclidean")
    q = _points(queries, query_key, query_vec, group, metric, [])
    c = _points(corpus, corpus_key, corpus_vec, group, metric, [])
    # co-grouping hashes keys as they are: an INT and a BIGINT of one value would meet in different partitions
    common = q.select("grp").union(c.select("grp")).schema["grp"].dataType
    q, c = (side.withColumn("grp", F.col("grp").cast(common)) for side in (q, c))
    layout = Layout(c, block_rows, lists)
    q = layout.place(q)
    if layout.split:
        q = cut_lineage(q, "queries")
    found_schema = T.StructType([
        T.StructField("grp", q.schema["grp"].dataType),
        T.StructField("id", q.schema["id"].dataType),
        T.StructField("other", c.schema["id"].dataType),
        T.StructField("d", T.DoubleType()),
        T.StructField("rank_value", T.DoubleType()),
    ])
    kernel = _top_k_kernel(k, metric, exclude_self)
    best = Window.partitionBy("grp", "id").orderBy("rank_value", "other")

    def merge(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = merge(scan_blocks(q, layout.corpus, kernel, found_schema, layout.block_rows))
    if layout.split:
        home = cut_lineage(found, "home")
        bounds = home.where(F.col("rank") == k).select("grp", "id", F.col("d").alias("bound"))
        bounded = q.join(bounds, ["grp", "id"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        far = scan_blocks(layout.other_lists(bounded), layout.corpus, kernel, found_schema, layout.block_rows)
        found = merge(home.drop("rank").unionByName(far))
    distance = F.col("d") * F.col("d") / 2.0 if metric == "cosine" else F.col("d")
    return found.select(
        "grp", F.col("id").alias("query_id"), F.col("other").alias("neighbour_id"), "rank", distance.alias("distance")
    )


def knn_graph(
    vectors: DataFrame, k: int, *, key: str = "document_id", vec: str = "embedding", group: str | None = None,
    metric: str = "cosine", block_rows: int = BLOCK_ROWS, lists: int = PIVOT_LISTS,
) -> DataFrame:
    """Each row's ``k`` nearest other rows (self excluded); see :func:`nearest`."""
    return nearest(
        vectors, vectors, k, query_key=key, corpus_key=key, query_vec=vec, corpus_vec=vec, group=group,
        metric=metric, exclude_self=True, block_rows=block_rows, lists=lists,
    )
