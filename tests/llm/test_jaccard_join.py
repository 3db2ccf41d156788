import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD
from trendloom.llm import jaccard_join
from trendloom.llm.components import connected_components

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 999)}"
            out.append(" ".join(words))
        else:
            out.append(" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 60, 150, 400]))))
    return out


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 70), (4, 3, 100)])
def test_equals_brute_force(docs, seed, size, percent):
    texts = edited(seed)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(texts), shingle=size, percent=percent).collect())
    assert got == brute(list(enumerate(texts)), size, percent)


def test_blocks_of_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(40)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(texts), shingle=3, percent=90).collect())
    assert got == brute(list(enumerate(texts)), 3, 90)


def test_linked_sets_agree_in_a_part():
    rng = np.random.default_rng(5)
    for percent in (70, 80, 90):
        schemes = jaccard_join.Schemes(percent)
        for size in [*range(1, 60), 200, 1000]:
            common = rng.integers(0, 1 << 62, size).astype(np.uint64)
            differ = size * (100 - percent) // percent
            other = np.concatenate([common, rng.integers(0, 1 << 62, differ).astype(np.uint64)])
            number, sign = jaccard_join.signatures([np.unique(common), np.unique(other)], schemes)
            assert set(sign[number == 0]) & set(sign[number == 1]), (percent, size)


def test_odd_rows(spark, odd, empty):
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(odd, shingle=3, percent=90).collect())
    assert got == brute([r[:2] for r in ODD], 3, 90)
    assert jaccard_join.jaccard_components(empty).count() == 0
    rows = jaccard_join.jaccard_components(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "x y z")], "doc_id long, text string"), shingle=3, percent=90).collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in rows) == [(-1, 1, None), (3, 1, 3), (3, 1, 3)]


def test_one_of_each_group_stays(docs):
    long = " ".join(f"w{i}" for i in range(200))
    kept = jaccard_join.drop_near_duplicates(docs([long, "other words here", long + " more", long, None, ""]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 5]
    assert kept.columns == ["doc_id", "text", "source"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (205, 203), (203, 204)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 203: 203, 204: 203, 205: 203}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropping_judges_rows_not_ids(spark):
    """Clean rows stay though their id is null or that of a copy; one row of each group stays."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, "clean words under the same id as a copy"), (3, long + " end"), (None, long), (None, "clean words without id at all"), (7, "x y z"), (7, "x y z")]
    kept = jaccard_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r[0] or 0), r[1]) for r in kept.collect()) == sorted([(3, long + " end"), (5, rows[1][1]), (0, rows[4][1]), (7, "x y z")])


def test_ids_of_any_type(spark):
    rows = [("b-2", "one two three four"), ("a-1", "one two three four"), ("c", "other words than these"), (None, "one two three four"), ("d", None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string"), shingle=3, percent=90).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a-1", 2, "a-1"), ("b-2", 2, "a-1"), ("c", 2, "c"), (None, 2, None), ("d", 0, "d")], key=str)


def test_forest_keeps_components_with_fewer_pairs_than_documents():
    import pyarrow as pa

    from trendloom.llm.packing import press

    rng = random.Random(3)
    parts = [np.array([[rng.randrange(40) for _ in range(60)], [rng.randrange(40, 60) for _ in range(60)]], dtype=np.int64) for _ in range(5)]
    table = pa.table([pa.array([0] * 5), pa.array([press(p) for p in parts], pa.binary())], names=["block", "tokens"])
    out = jaccard_join._forest(table).to_pydict()
    pairs = {(int(x), int(y)) for p in parts for x, y in p.T}
    nodes = {n for p in pairs for n in p}

    def components(edges):
        root = {n: n for n in nodes}
        for _ in nodes:
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        return root

    forest = list(zip(out["a"], out["b"]))
    assert set(forest) <= pairs and len(forest) < len(nodes) and components(forest) == components(pairs)


def test_blocks_are_bounded_whatever_the_shuffle_partitions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert sum(i != c for i, _, c in known) == 20
    told = []
    tell = jaccard_join._tell_slots
    monkeypatch.setattr(jaccard_join, "_tell_slots", lambda shingle, bits, part_bits: told.append(part_bits) or tell(shingle, bits, part_bits))
    monkeypatch.setattr(jaccard_join, "PARTITION_TEXT", 1000)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()} == known
    assert 1 << told[0] >= sum(len(t) for _, t in rows) / 1000


def test_long_sets_are_signed_few_at_a_time():
    lengths = np.array([10] * 2500 + [200_000] * 4 + [2_000_000, 5])
    parts = jaccard_join.signed_together(lengths)
    assert np.concatenate(parts).tolist() == list(range(len(lengths)))
    assert max(map(len, parts)) <= jaccard_join.SIGNED_SETS
    assert all(lengths[p].sum() <= 2 * jaccard_join.SIGNED_TOKENS or len(p) <= 2 for p in parts)
