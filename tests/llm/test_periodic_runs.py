"""Periodic runs against a brute-force search, on random, repetitive and planted word sequences."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.llm.periodic_runs import describe_texts, least_rotation, mark_periodic_runs, synchronising_positions
from trendloom.llm.registered import ORACLES, QUERIES


def brute_runs(words):
    """[start, length, period] of all runs, by their definition."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted([s, length, q] for (s, length), q in best.items() if length >= max(12, 2 * q))


def by_start_and_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    return list(describe_texts(data, at))


def check(texts):
    for text, (count, runs, kept) in zip(texts, found(texts), strict=True):
        words = text.split()
        expected = by_start_and_period(brute_runs(words))
        assert runs == expected and count == len(expected)
        assert kept.decode() == collapsed(words, expected)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def grown(draw):
    """Words made by copying, repeating and changing what is there, which gives nested and overlapping periods."""
    words = [draw.choice("ab") for _ in range(draw.randint(1, 6))]
    while len(words) < draw.randint(20, 400):
        kind = draw.random()
        start = draw.randrange(len(words))
        piece = words[start : start + draw.randint(1, 40)]
        words += piece * draw.randint(1, 5) if kind < 0.7 else [draw.choice("abc")]
    return " ".join(words[:400])


@pytest.mark.parametrize("seed", range(300))
def test_nested_repeats_against_brute_force(seed):
    draw = random.Random(seed)
    check([grown(draw) for _ in range(6)])


@pytest.mark.parametrize("text", [
    "", " \t\n", "a", "a " * 12, "a " * 11, "a b " * 300, " ".join(fibonacci(600)), " ".join("a" * 50 + "b" + "a" * 50 + "b" + "a" * 50), " ".join("b" + "ababa" * 2 + "b"),
    " ".join("ab" * 20 + "a" + "ab" * 20 + "a" + "ba" * 9), " ".join((("ab" * 9 + "c") * 3 + "d") * 4), " ".join(str(bin(i).count("1") % 2) for i in range(512)),
    " ".join(f"w{i % 97}" for i in range(97 * 4 + 5)), " ".join(f"w{i}" for i in range(500)) + " x" * 40 + " y z" * 30,
])
def test_known_sequences(text):
    check([text, "a a a", text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=4))
def test_two_letters(texts):
    check([" ".join(t) for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=24), st.text("ab", max_size=12), st.integers(1, 12), st.text("abc", max_size=30))
def test_powers_between_other_words(root, tail, times, around):
    check([" ".join(around + root * times + tail + root * 2 + around)])


def test_no_run_crosses_texts():
    check(["a b " * 5, "a b " * 5, "a b " * 5, "a", "a b " * 9])


def test_synchronising_set_is_consistent_and_dense():
    draw = random.Random(1)
    words = np.array([draw.randrange(3) for _ in range(3000)], dtype=np.uint64)
    scale = 8
    fragments = np.array([hash(words[i : i + scale].tobytes()) % 2**64 for i in range(len(words) - scale + 1)], dtype=np.uint64)
    chosen = synchronising_positions(fragments, scale)
    assert np.diff(chosen).max() <= scale and chosen[0] < scale and len(chosen) < len(words) / 2
    selected, by_context = set(chosen.tolist()), {}
    for i in range(len(words) - 2 * scale + 1):
        assert by_context.setdefault(words[i : i + 2 * scale].tobytes(), i in selected) == (i in selected)


def test_least_rotation():
    draw = random.Random(2)
    for _ in range(200):
        words = [draw.randrange(3) for _ in range(draw.randint(1, 12))]
        turn = least_rotation(words)
        assert words[turn:] + words[:turn] == min(words[i:] + words[:i] for i in range(len(words)))


def test_odd_rows(spark, odd, empty):
    rows = mark_periodic_runs(odd.withColumn("n_runs", F.lit("old"))).collect()
    assert len(rows) == 12 and all(r["n_runs"] == 0 and r["start"] is None and r["runs"] == [] for r in rows)
    assert {r["doc_id"]: r["collapsed"] for r in rows}[3] == "" and {r["doc_id"]: r["collapsed"] for r in rows}[5] == "One two"
    assert mark_periodic_runs(empty).count() == 0
    long = spark.createDataFrame([(1, "x y z " * 200_000), (1, "x y z " * 200_000), (None, "a " * 13)], "doc_id long, text string")
    got = [(r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"]) for r in mark_periodic_runs(long).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(1, 0, 13, 1, 13000, "a"), (1, 0, 600_000, 3, 200_000_000, "x y z"), (1, 0, 600_000, 3, 200_000_000, "x y z")]


def planted(doc_id, words):
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_over_all_documents(spark, sf_dir):
    import duckdb

    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        words = planted(doc["doc_id"], (doc["text"] or "").split())
        if len(words) < 1500:
            runs = by_start_and_period(brute_runs(words))
            got = rows[doc["doc_id"]]
            assert got["n_runs"] == len(runs)
            assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            assert got["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    twin = duckdb.sql(ORACLES["op12_periodic_runs"])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r[n] for n in names) for r in rows.values()) == sorted(twin.select(", ".join(f'"{n}"' for n in names)).fetchall())
