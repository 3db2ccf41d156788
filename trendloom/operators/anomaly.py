"""Anomalies of daily series.

A series has one row per day, so gathering one cluster's days into an array is
bounded by the calendar.  Both detectors then run as expressions on that array:
one shuffle by cluster, no pairs of rows, no Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.arrays import let, total
from trendloom.runtime import require
from trendloom.sources.tables import replace_by_key

DEFAULT_CONTAMINATION = 0.1
MIN_POINTS = 3
MAX_NEIGHBOURS = 5
SCORE_DIGITS = 6
# Euler's constant, and the guard of the local outlier factor.
EULER = 0.5772156649
DENSITY_GUARD = 1e-10
# Spread below which a column counts as constant.
FLAT = 1e-12
TREES = 100
SUBSAMPLE = 256


def contamination_or_default(contamination: float) -> float:
    """Shares outside (0, 0.5] fall back to a tenth."""
    return contamination if 0 < contamination <= 0.5 else DEFAULT_CONTAMINATION


def anomaly_features(series: DataFrame) -> DataFrame:
    """z-scores per cluster of count, sentiment and momentum (missing = 0)."""
    w = Window.partitionBy("cluster_id")
    out = series
    for source, name in (("mention_count", "z_count"), ("avg_sentiment", "z_sentiment"), ("momentum", "z_momentum")):
        x = F.coalesce(F.col(source).cast("double"), F.lit(0.0))
        sigma = F.stddev_pop(x).over(w)
        out = out.withColumn(name, F.when(sigma > FLAT, (x - F.avg(x).over(w)) / sigma).otherwise(F.lit(0.0)))
    return out


def _path_constant(n: Column) -> Column:
    """Average depth of an unsuccessful search among ``n`` points."""
    n = n.cast("double")
    many = 2.0 * (F.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return F.when(n > 2, many).when(n == 2, 1.0).otherwise(0.0)


def _percentile(values: Column, share: float) -> Column:
    """Linear-interpolated percentile of an array."""
    position = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(position).cast("int"), F.ceil(position).cast("int")

    def between(ordered: Column) -> Column:
        at = F.get(ordered, low)
        return at + (F.get(ordered, high) - at) * (position - low)

    return let(F.array_sort(values), between)


def _gathered(series: DataFrame) -> DataFrame:
    """One row per cluster of at least three days, its days as a sorted array."""
    point = F.struct(
        F.col("summary_date").alias("day"),
        F.col("mention_count").cast("double").alias("n"),
        F.coalesce("avg_sentiment", F.lit(0.0)).alias("s"),
        F.coalesce("momentum", F.lit(0.0)).alias("m"),
        F.col("avg_sentiment").alias("raw_s"),
        F.col("momentum").alias("raw_m"),
    )
    grouped = series.groupBy("cluster_id").agg(F.sort_array(F.collect_list(point)).alias("p"))
    return grouped.where(F.size("p") >= MIN_POINTS)


def _standardised(values: Column) -> Column:
    """z-scores of an array, all zero when it is constant."""

    def centred(c: Column) -> Column:
        sigma = F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c))
        return let(sigma, lambda s: F.transform(c, lambda x: F.when(s > FLAT, x / s).otherwise(F.lit(0.0))))

    def around_mean(v: Column) -> Column:
        return let(total(v) / F.size(v), lambda mean: let(F.transform(v, lambda x: x - mean), centred))

    return let(values, around_mean)


def _scored(gathered: DataFrame, scores: Column, z: Column, contamination: float, kind: str, metadata) -> DataFrame:
    """Rows strictly above the percentile of their own cluster's scores."""
    tagged = gathered.withColumn("score", scores).withColumn("z", z)
    tagged = tagged.withColumn("threshold", _percentile(F.col("score"), 1.0 - contamination))
    rows = tagged.select("cluster_id", "threshold", F.explode(F.arrays_zip("p", "score", "z")).alias("r"))
    flagged = rows.where(F.col("r.score") > F.col("threshold"))
    return flagged.select(
        "cluster_id", F.col("r.p.day").alias("anomaly_date"), F.col("r.score").alias("score"), F.lit(kind).alias("type"),
        F.signum("r.z").cast("int").alias("direction"), F.to_json(metadata(F.col("r.p"))).alias("anomaly_metadata"),
    )


def volume_anomalies(series: DataFrame, contamination: float = DEFAULT_CONTAMINATION) -> DataFrame:
    """Days whose count isolates fastest.

    The expected depth of a point in a random isolation tree over one column is
    the sum, over all gaps, of the gap's share of the range between the point
    and the gap's far end; equal counts add the depth of a tie.  Score is
    ``2 ** (-depth / c(n))``, rounded so that equal scores stay equal.
    """
    share = contamination_or_default(contamination)
    days = _gathered(series)

    def pairs(v: Column) -> Column:
        last = F.size(v) - 1
        return F.zip_with(
            F.slice(v, F.lit(1), last), F.slice(v, F.lit(2), last), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        )

    def depth(x: Column, p: Column, gaps: Column) -> Column:
        def add(acc: Column, g: Column) -> Column:
            reach = F.when(g["lo"] >= x, g["hi"] - x).otherwise(x - g["lo"])
            return acc + (g["hi"] - g["lo"]) / reach

        ties = F.size(F.filter(p, lambda q: q["n"] == x))
        return F.aggregate(gaps, F.lit(0.0), add) + _path_constant(ties)

    def score_all(p: Column, gaps: Column) -> Column:
        base = _path_constant(F.size(p))
        return F.transform(p, lambda q: F.round(F.pow(F.lit(2.0), -depth(q["n"], p, gaps) / base), SCORE_DIGITS))

    distinct = F.array_sort(F.array_distinct(F.transform("p", lambda q: q["n"])))
    gaps = let(distinct, pairs)
    scores = let(gaps, lambda g: score_all(F.col("p"), g))
    z = _standardised(F.transform("p", lambda q: q["n"]))
    return _scored(
        days, scores, z, share, "volume_spike",
        lambda p: F.struct(
            p["n"].cast("bigint").alias("mention_count"), F.lit("isolation").alias("model"), F.lit(share).alias("contamination")
        ),
    )


def sentiment_anomalies(series: DataFrame, contamination: float = DEFAULT_CONTAMINATION) -> DataFrame:
    """Local outlier factor on standardised (sentiment, momentum).

    ``k = min(5, n - 1)`` neighbours; equal distances are taken in date order.
    """
    share = contamination_or_default(contamination)
    days = _gathered(series)
    zs = _standardised(F.transform("p", lambda q: q["s"]))
    zm = _standardised(F.transform("p", lambda q: q["m"]))

    def neighbours(z: Column) -> Column:
        k = F.least(F.lit(MAX_NEIGHBOURS), F.size(z) - 1)

        def of(a: Column, i: Column) -> Column:
            def to(b: Column, j: Column) -> Column:
                d = F.sqrt(F.pow(a["a"] - b["a"], 2.0) + F.pow(a["b"] - b["b"], 2.0))
                return F.when(i != j, F.struct(F.round(d, 9).alias("r"), j.alias("j"), d.alias("d")))

            return F.slice(F.array_sort(F.filter(F.transform(z, to), lambda x: x.isNotNull())), F.lit(1), k)

        return F.transform(z, of)

    def densities(nn: Column) -> Column:
        def with_reach(kd: Column) -> Column:
            def density(x: Column) -> Column:
                reach = total(F.transform(x, lambda e: F.greatest(e["d"], F.get(kd, e["j"]))))
                return F.lit(1.0) / (reach / F.size(x) + DENSITY_GUARD)

            return F.transform(nn, density)

        return let(F.transform(nn, lambda x: F.element_at(x, -1)["d"]), with_reach)

    def factors(nn: Column) -> Column:
        def against(lrd: Column) -> Column:
            def ratio(x: Column, i: Column) -> Column:
                around = total(F.transform(x, lambda e: F.get(lrd, e["j"]))) / F.size(x)
                return F.round(around / F.get(lrd, i), SCORE_DIGITS)

            return F.transform(nn, ratio)

        return let(densities(nn), against)

    z = F.zip_with(zs, zm, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ratios = let(let(z, neighbours), factors)
    return _scored(
        days, ratios, zs, share, "sentiment_spike",
        lambda p: F.struct(
            p["raw_s"].alias("avg_sentiment"), p["raw_m"].alias("momentum"), F.lit("local_outlier_factor").alias("model"),
            F.lit(share).alias("contamination"),
        ),
    )


def normalize_scores(anomalies: DataFrame) -> DataFrame:
    """Min-max over the flagged rows of each cluster and type; one value gives 1."""
    w = Window.partitionBy("cluster_id", "type")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return anomalies.withColumn("score", scaled)


def detect_anomalies(series: DataFrame, contamination: float = DEFAULT_CONTAMINATION) -> DataFrame:
    """Volume and sentiment anomalies with scores on one 0..1 scale."""
    both = volume_anomalies(series, contamination).unionByName(sentiment_anomalies(series, contamination))
    return normalize_scores(both)


def replace_anomalies(current: DataFrame, fresh: DataFrame, processed: DataFrame) -> DataFrame:
    return replace_by_key(current, fresh, ["cluster_id"], processed)


# Isolation forest over several columns ------------------------------------------


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """One tree as rows (column, cut, left, right, depth); leaves have column -1."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def tail(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + tail(len(rows))))
        low, high = rows.min(0), rows.max(0)
        open_columns = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_columns):
            col = int(rng.choice(open_columns))
            cut = float(rng.uniform(low[col], high[col]))
            below = rows[:, col] < cut
            left, right = build(rows[below], depth + 1) if below.any() else -1, -1
            if left >= 0 and not below.all():
                right = build(rows[~below], depth + 1)
            if left >= 0 and right >= 0:
                nodes[at] = (col, cut, left, right, 0.0)
        return at

    build(x, 0)
    return nodes


def _depths(x: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    col, cut = nodes["col"].to_numpy(), nodes["cut"].to_numpy()
    left, right, depth = nodes["lft"].to_numpy(), nodes["rgt"].to_numpy(), nodes["depth"].to_numpy()
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = col[at] >= 0
        if not inner.any():
            return depth[at]
        rows = np.flatnonzero(inner)
        here = at[rows]
        at[rows] = np.where(x[rows, col[here]] < cut[here], left[here], right[here])


def isolation_forest(series: DataFrame, columns: list[str], key: str = "cluster_id", row: str = "summary_date",
                     trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42, chunk_rows: int = 65536) -> DataFrame:
    """Isolation score of every row over several columns.

    Each tree draws ``subsample`` rows of its series by hash.  A series of no
    more rows gives them all to every tree and goes to one task once.  Of a longer one only rows
    whose hash for a tree lies below a bound (from the series' length, with room for chance) are copied for
    that tree, and a task grows one tree.  Rows are then scored in chunks of bounded size, so a long series spreads
    over many tasks.
    """
    require(trees >= 1 and subsample >= 2, "trees and subsample must be positive")
    data = series.select(key, row, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    lengths = data.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counted = data.join(lengths, key)
    key_type = series.schema[key].dataType.simpleString()
    shape = f"{key} {key_type}, tree INT, node INT, col INT, cut DOUBLE, lft INT, rgt INT, depth DOUBLE, size INT"
    order = [key, "tree", "node", "col", "cut", "lft", "rgt", "depth", "size"]

    def tree_of(name, tree: int, x: np.ndarray) -> pd.DataFrame:
        nodes = _grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2)))))
        out = pd.DataFrame(nodes, columns=["col", "cut", "lft", "rgt", "depth"])
        return out.assign(**{key: name, "tree": tree, "node": range(len(out)), "size": len(x)})[order]

    def grow_all(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(row)[columns].to_numpy(float)
        return pd.concat([tree_of(k[0], t, x) for t in range(trees)])

    def grow(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tree_of(k[0], int(k[1]), pdf.sort_values("_r")[columns].to_numpy(float))

    short = counted.where(F.col("_n") <= subsample).drop("_n").groupBy(key).applyInPandas(grow_all, shape)
    share = F.least(F.lit(1.0), (subsample + 8 * float(np.sqrt(subsample)) + 16) / F.col("_n"))

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), tree, F.col(row)), F.lit(1 << 30))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < share * float(1 << 30))
    sampled = counted.where(F.col("_n") > subsample).withColumn("tree", F.explode(chosen)).drop("_n")
    draw = Window.partitionBy(key, "tree").orderBy(drawn(F.col("tree")), row)
    sampled = sampled.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= subsample)
    forest = sampled.groupBy(key, "tree").applyInPandas(grow, shape).unionByName(short)
    sizes = data.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    chunked = data.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64(row), "chunks").cast("int")).drop("chunks")
    copies = forest.join(sizes, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def score(points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if points.empty:
            return pd.DataFrame(columns=[key, row, "score"])
        x = points[columns].to_numpy(float)
        per_tree = [_depths(x, t.sort_values("node")) for _, t in nodes.groupby("tree")]
        n = max(int(nodes["size"].max()), 2)
        c = 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
        return points[[key, row]].assign(score=np.power(2.0, -np.mean(per_tree, axis=0) / c))

    row_type = series.schema[row].dataType.simpleString()
    scored = chunked.groupBy(key, "chunk").cogroup(copies.groupBy(key, "chunk"))
    return scored.applyInPandas(score, f"{key} {key_type}, {row} {row_type}, score DOUBLE")
