"""Exact neighbours, search and projection against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import projection, search
from trendloom.operators.neighbours import GROUP_BLOCKS, Layout, knn_graph, nearest
from trendloom.runtime import shared_dir


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    pdf = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    return pdf["vec_id"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id AS document_id", "'default' AS model_name", "embedding", "vec_id % 2 AS user_id"
    )


def brute(ids, x, k, same):
    d = np.round(1 - x @ x.T, 9)
    out = {}
    for i, a in enumerate(ids):
        ok = np.flatnonzero(same(ids, a) & (ids != a))
        out[a] = ids[ok[np.lexsort((ids[ok], d[i][ok]))[:k]]].tolist()
    return out


@pytest.mark.parametrize("block_rows", [2048, 60])
def test_knn_is_exact_for_one_and_many_blocks(spark, sf_dir, vectors, block_rows):
    ids, x = vectors
    got = knn_graph(frame(spark, sf_dir), 6, group="user_id", block_rows=block_rows, lists=8).toPandas()
    lists = got.sort_values("rank").groupby("query_id")["neighbour_id"].apply(list).to_dict()
    assert lists == brute(ids, x, 6, lambda i, a: i % 2 == a % 2)


def test_copies_rank_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)] + [(9, [0.0, 0.0]), (10, None)], "document_id LONG, embedding ARRAY<DOUBLE>")
    got = knn_graph(rows, 3, block_rows=3, lists=2).toPandas().sort_values(["query_id", "rank"])
    assert got[got["query_id"] == 4]["neighbour_id"].tolist() == [0, 1, 2] and set(got["query_id"]) == set(range(9))


def test_search_rejects_bad_input(spark, sf_dir):
    rows = frame(spark, sf_dir)
    with pytest.raises(ValueError):
        search.search_embeddings(rows, [1.0, 2.0], dim=64)
    with pytest.raises(ValueError):
        search.search_embeddings(rows, [1.0] * 64, dim=64, max_distance=3)
    with pytest.raises(ValueError):
        search.semantic_search(spark, "   ", rows, rows, dim=64)


def test_inverted_lists_reach_high_recall(spark, sf_dir, vectors):
    ids, x = vectors
    rows = frame(spark, sf_dir)
    centres = search.list_centres(rows, lists=10)
    queries = rows.withColumnRenamed("document_id", "query_id")
    exact = {(r.query_id, r.document_id) for r in search.batch_search(queries, rows).collect()}
    near = {(r.query_id, r.document_id) for r in search.ann_batch_search(queries, rows, centres, n_probe=8, block_rows=100).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    all_lists = {(r.query_id, r.document_id) for r in search.ann_batch_search(queries, rows, centres, n_probe=10).collect()}
    assert all_lists == exact
    path = shared_dir(spark, "lists")
    search.write_lists(rows, centres, path)
    one = [r.document_id for r in search.ann_search(spark, path, centres, list(x[3]), n_probe=10).collect()]
    assert set(one) == {d for q, d in exact if q == ids[3]}


def trust(x, y, k=15):
    n = len(x)
    high = np.argsort(np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1), axis=1)
    low = np.argsort(((y[:, None] - y[None]) ** 2).sum(-1), axis=1)[:, 1 : k + 1]
    excess = sum(max(0, high[i, j] - k) for i in range(n) for j in low[i])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * excess


def test_graph_layout_keeps_neighbours_better_than_pca(spark, vectors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(160, 16)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "document_id LONG, embedding ARRAY<DOUBLE>")
    flat = projection.project_2d(rows, method="pca").toPandas().sort_values("document_id")[["x", "y"]].to_numpy()
    graph = projection.project_2d(rows, epochs=15).toPandas().sort_values("document_id")[["x", "y"]].to_numpy()
    assert np.isfinite(graph).all() and trust(x, graph) > trust(x, flat)


def test_every_pair_of_a_group_can_repel(spark):
    n = 3000
    places = spark.range(n).select(F.lit(0).alias("grp"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    places = projection.with_cells(places.unionByName(places.where("id < 3").withColumn("grp", F.lit(1))))
    met = projection.tries_in_cells(places, 0, 7).toPandas()
    big, small = met[met.grp == 0], met[met.grp == 1]
    assert len(big) == n * projection.NEGATIVES and len(small) == 3 * projection.NEGATIVES
    assert set(small.oid) <= {0, 1, 2} and (big.bx == big.oid).all() and (big.ax == big.id).all()
    assert big.oid.nunique() > 0.95 * n and big.oid.value_counts().max() < 8 * projection.NEGATIVES
    assert abs(big.groupby("id").oid.mean().mean() - n / 2) < n / 20
    again = projection.tries_in_cells(places.repartition(7), 0, 7).toPandas()
    order = ["grp", "id", "oid"]
    assert met.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()


def test_spectral_start_finds_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(3)
    part = np.repeat([0, 1, 2], 12)
    w = np.where(part[:, None] == part[None], 1.0, 0.02) * rng.uniform(0.5, 1.0, (36, 36))
    w = np.triu(w, 1) + np.triu(w, 1).T
    edges = spark.createDataFrame([(g, i, j, float(w[i, j])) for g in (0, 1) for i in range(36) for j in range(36) if i != j], "grp INT, a LONG, b LONG, w DOUBLE")
    start = rng.normal(size=(37, 2))
    places = spark.createDataFrame([(g, i, *map(float, start[i])) for g in (0, 1) for i in range(37)] + [(2, 0, 1.5, 2.5)], "grp INT, id LONG, x DOUBLE, y DOUBLE")
    found = projection.spectral_start(places, edges, rounds=25).toPandas().sort_values(["grp", "id"])
    a, b = (found[found.grp == g][["x", "y"]].to_numpy() for g in (0, 1))
    assert found[found.grp == 2][["x", "y"]].values.tolist() == [[1.5, 2.5]]  # nor does a group without any
    assert np.allclose(a, b) and np.allclose(a[36], start[36])  # a point without an edge stays
    d = w.sum(1)
    values, vectors_ = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    wanted = vectors_[:, -3:-1]
    ours = a[:36] * np.sqrt(d)[:, None]
    ours, _ = np.linalg.qr(ours)
    assert np.linalg.svd(wanted.T @ ours, compute_uv=False).min() > 0.999


def test_groups_of_different_number_types_meet(spark):
    rows = spark.range(60).selectExpr("id AS q", "id % 5 AS owner", "array(cast(id + 1 AS double), 1D) AS embedding")
    centres = spark.range(10).selectExpr("id AS c", "cast(id % 5 AS INT) AS owner", "array(cast(id AS double), 1D) AS embedding")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions too large to be merged
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = nearest(rows, centres, 1, query_key="q", corpus_key="c", group="owner").collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert {r["query_id"] for r in found} == set(range(60))


def test_every_row_travels_to_few_blocks(spark):
    """Vectors that no list rules out: visits carry a row once a block of the group, not once a cell."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id LONG, vec ARRAY<DOUBLE>").withColumn("grp", F.lit(0))
    layout = Layout(rows, 100, 64)
    per_list = {r["lst"]: r["count"] for r in layout.corpus.groupBy("lst").count().collect()}
    assert sum(per_list.values()) == 1200 and len(per_list) <= GROUP_BLOCKS and layout.block_rows == 150
    visits = layout.other_lists(layout.place(rows).withColumn("bound", F.lit(100.0)))
    assert visits.count() == 1200 * (len(per_list) - 1)


def test_long_vectors_are_ranked_exactly(spark):
    """Far from the origin products lose digits; the neighbours are those of the differences."""
    rng = np.random.default_rng(4)
    x = 1e5 + rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "document_id LONG, embedding ARRAY<DOUBLE>")
    got = knn_graph(rows, 4, metric="euclidean", block_rows=40, lists=12).toPandas().sort_values("rank")
    gaps = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(300, np.inf))
    assert got.groupby("query_id")["neighbour_id"].apply(list).to_dict() == {i: np.argsort(gaps[i])[:4].tolist() for i in range(300)}


def test_nine_of_twenty_lists_find_nine_of_ten(spark):
    """Vectors without much structure: as many rows as nine lists of twenty hold give a recall of 0.9 (whole lists 0.88)."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(10, 64)), 200, axis=0) * 0.33 + rng.normal(size=(2000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "document_id LONG, embedding ARRAY<DOUBLE>")
    queries = rows.withColumnRenamed("document_id", "query_id").where("query_id % 4 = 0")
    centres = search.list_centres(rows, lists=20)
    near = search.ann_batch_search(queries, rows, centres, n_probe=9).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(i, j) for i in range(0, 2000, 4) for j in np.argsort(-(unit[i] @ unit.T), kind="stable")[:10]}
    assert len(near) == 5000 and len(exact & set(zip(near["query_id"], near["document_id"]))) / len(exact) >= 0.9


def test_neighbours_on_a_map_are_the_nearest_places(spark):
    """Also in a clump that is small beside the map."""
    from checks.q_jobs import map_neighbours

    order = np.random.default_rng(0).permutation(60).tolist()
    rows = [(i, 0, 1e-4 * at, 0.0) for at, i in enumerate(order)] + [(100, 0, 9.0, -9.0)]
    found = {(r["query_id"], r["neighbour_id"]) for r in map_neighbours(spark.createDataFrame(rows, "document_id long, user_id int, x double, y double"), 4).collect()}
    for at in range(2, 58):
        assert {b for a, b in found if a == order[at]} == {order[at + s] for s in (-2, -1, 1, 2)}


def test_packed_edges_send_every_place_and_split_hubs(spark):
    n = 3 * projection.PACKED_EDGES
    half = [(0, i, n, 0.5) for i in range(n)] + [(0, 0, 1, 2.0), (1, 0, 1, 1.0)]
    edges = spark.createDataFrame(half + [(g, b, a, w) for g, a, b, w in half], "grp int, a long, b long, w double")
    places = spark.createDataFrame([(0, i, float(i), -float(i)) for i in range(n + 1)] + [(1, 0, 7.0, 0.0), (1, 1, 8.0, 0.0)], "grp int, id long, x double, y double")
    packed = projection.packed_edges(edges)
    assert packed.agg(F.max(F.size("near"))).first()[0] < 1.5 * projection.PACKED_EDGES and packed.where(f"id < {n}").groupBy("grp", "id").count().where("count > 1").count() == 0
    sent = projection.sent_along(places, packed)
    want = edges.join(places.withColumnRenamed("id", "b"), ["grp", "b"]).select("grp", "a", "w", F.col("x").alias("bx"), F.col("y").alias("by"))
    got = sent.select("grp", "a", "w", "bx", "by")
    assert got.count() == edges.count() and got.exceptAll(want).count() == 0


def test_blocks_of_inverted_lists_grow_with_the_table(spark, monkeypatch):
    """Else a query travels to ever more blocks of a list, and a row to ever more blocks of queries."""
    x = np.random.default_rng(3).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "document_id LONG, embedding ARRAY<DOUBLE>")
    queries = rows.withColumnRenamed("document_id", "query_id")
    centres = search.list_centres(rows, lists=4)
    cells, scan, used = search.list_cells(rows.selectExpr("embedding AS vec"), centres), search.scan_blocks, []
    monkeypatch.setattr(search, "list_cells", lambda *a: cells)

    def found(cut):
        monkeypatch.setattr(search, "scan_blocks", lambda v, c, k, s, n, **o: used.append(n) or scan(v, c, k, s, cut or n, **o))
        return sorted(map(tuple, search.ann_batch_search(queries, rows, centres, n_probe=2, block_rows=16).collect()))

    assert found(None) == found(9)
    assert used[0] == -(-600 // GROUP_BLOCKS)
