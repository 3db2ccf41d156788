"""Exact duplicates, shards, mixes, preference pairs, scores and the pipeline."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD, fold
from trendloom.llm import exact_dedup, lm_score, mixing, preferences, sharding

RANKS = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- exact duplicates

def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def marked(df):
    return sorted(tuple(r) for r in exact_dedup.mark_exact_duplicates(df, "doc_id", "text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 1000])
def test_exact_duplicates_by_text_ids(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", table_bytes)
    texts = [f"text {i % 40} " * (i % 40) for i in range(200)]
    ids = [None if i % 50 == 7 else f"{'aé😀'[i % 3]}-{i}" for i in range(200)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id STRING, text STRING").repartition(5)
    best = {t: max((d for d, x in zip(ids, texts, strict=True) if x == t and d is not None), default=None) for t in texts}
    want = [(d, best[t], texts.count(t), d == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in zip(ids, texts, strict=True)]
    key = lambda r: (r[4], str(r[0]))
    got = exact_dedup.mark_exact_duplicates(df, "doc_id", "text").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    decimals = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id INT, text STRING").selectExpr("cast(doc_id AS DECIMAL(5, 1)) AS doc_id", "text")
    assert [(r.keep_id, r.kept) for r in exact_dedup.mark_exact_duplicates(decimals, "doc_id", "text").orderBy("doc_id").collect()] == [("2.0", False), ("2.0", True)]


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 2000])
def test_exact_duplicates(docs, odd, empty, monkeypatch, table_bytes):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", table_bytes)
    rng = random.Random(1)
    texts = [rng.choice(["same", "other ", "", None, f"t{rng.randint(0, 40)}" * rng.randint(1, 3)]) for _ in range(300)]
    assert marked(docs(texts)) == brute_groups(list(enumerate(texts)))
    assert marked(odd) == brute_groups([r[:2] for r in ODD])
    assert marked(empty) == []


def test_spilled_buckets_give_the_same(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLE_BYTES", 3000)
    import pyarrow as pa

    contents = [f"content {i % 97}".encode() * 5 for i in range(500)]
    batch = pa.record_batch([pa.array([hashlib.sha256(c).digest() for c in contents]), pa.array(contents), pa.array(range(500), pa.int64()), pa.array([1] * 500, pa.int64())], schema=exact_dedup.CONTENT)
    rows = [r for b in exact_dedup._resolve([batch.slice(i, 20) for i in range(0, 500, 20)]) for r in b.to_pylist()]
    want = {hashlib.sha256(c).digest(): (max(i for i, x in enumerate(contents) if x == c), contents.count(c)) for c in contents}
    assert {r["digest"]: (r["keep"], r["n"]) for r in rows} == want and len(rows) == 97


def test_equal_digests_of_different_contents_stay_apart():
    table = exact_dedup.ContentTable()
    for content in (b"a", b"b", b"a"):
        table.add(b"0" * 32, content, 1, 1)
    assert table.n == [2, 1]


# ---------------------------------------------------------------- shards

def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    out = sharding.shard_records(rows, "doc_id", [1.0] * 8, grown_weights=[1.0] * 9).toPandas()
    assert set(out["grown_shard"][out["grown_shard"] != out["shard"]]) == {8}
    assert (out.groupby("shard").size() - 625).abs().max() < 120 and abs((out["grown_shard"] == 8).sum() - 5000 / 9) < 120
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    again = sharding.shard_records(rows, "doc_id", [1.0] * 8, grown_weights=[1.0] * 9).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_weights_set_shares(spark):
    rows = spark.range(8000).withColumnRenamed("id", "doc_id")
    sizes = sharding.shard_records(rows, "doc_id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in sizes}[1] / 8000 - 0.75) < 0.03


def test_sharding_odd_rows(spark, odd, empty):
    out = sharding.shard_records(odd.unionByName(odd).withColumn("shard", odd["doc_id"]), "doc_id", [1.0] * 3).toPandas()
    assert len(out) == 2 * len(ODD) and out.groupby("doc_id")["shard"].nunique().max() == 1
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.shard_records(empty, "doc_id", [1.0]).count() == 0
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "doc_id long")
    assert sharding.shard_records(nulls, "doc_id", [1.0] * 4).where("doc_id IS NULL").select("shard").distinct().count() == 1


# ---------------------------------------------------------------- mixes

def test_targets_stop_at_three_sizes():
    sizes = np.array([100, 1000, 10, 0])
    target = mixing.capped_targets(sizes, np.array([1.0, 2, 3, 1]), 1110.0, 3)
    assert target[2] == 30 and target[3] == 0 and target[0] == 300 and abs(target.sum() - 1110) < 1e-9


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), n, 12345)
        assert sorted(out) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


def mix_rows():
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(0, 300)) for _ in range(150)]
    return texts, [rng.choice(["a", "b", "é", None, "a", "a"]) for _ in texts]


def test_mix_comes_near_its_targets(docs):
    texts, sources = mix_rows()
    out = mixing.mix_documents(docs(texts, sources), block_words=8).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert out["size"].tolist() == [len(words_of(t)) for t in texts]
    out["source"] = [s or "" for s in sources]
    names = sorted(set(out["source"]), key=lambda s: (s == "", s))
    size = np.array([out["size"][out["source"] == s].sum() for s in names])
    want = mixing.capped_targets(size, np.array([1.0, 2, 3, 1])[: len(names)], float(size.sum()), 3)
    for s, t, z in zip(names, want, size):
        mine = out[out["source"] == s]
        assert abs(mine["target"].iloc[0] - t) < 1e-6 and mine["source_size"].iloc[0] == z and abs(mine["taken"].sum() - t) <= 16
    assert (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix_documents(docs(texts, sources), block_words=8).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again["taken"].tolist() == out["taken"].tolist()


def test_mixed_text_equals_what_is_counted(spark, docs):
    texts, sources = mix_rows()
    texts = [" ".join(f"d{i}w{k}" for k in range(len(words_of(t)))) for i, t in enumerate(texts)]
    df = docs(texts, sources)
    sized = df.select("source", mixing.word_count(df["text"]).alias("size"))
    plan = mixing.plan_mix(sized, block_words=8, shard_slots=100)
    pieces = mixing.mixed_text(df, plan).collect()
    counted = collections.Counter()
    for p in pieces:
        words = p["text"].split(" ")
        assert words[0] == f"d{p['doc_id']}w{p['first']}"
        counted[p["doc_id"]] += len(words)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(df, block_words=8, shard_slots=100).collect()}
    assert {k: v for k, v in taken.items() if v} == dict(counted)
    slots = mixing.mixed_slots(spark, plan).groupBy("shard").count().collect()
    assert sorted((r["count"] for r in slots), reverse=True)[:-1] == [100] * (len(slots) - 1) and sum(r["count"] for r in slots) == plan.slots.sum()


def test_mixing_odd_rows(odd, empty, docs):
    rows = {r["doc_id"]: r for r in mixing.mix_documents(odd).collect()}
    assert len(rows) == len(ODD) and all(r["size"] == len(words_of(t)) and r["taken"] <= 3 * r["size"] for (i, t, _), r in zip(ODD, [rows[x[0]] for x in ODD]))
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mix_documents(docs([None, ""])).select("taken").distinct().collect()[0][0] == 0
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(odd).collect())
    assert all(copies[i] == 1 for i in (1, 2, 3))


def test_mixing_counts_rows_with_null_and_repeated_ids_by_themselves(spark):
    """Sizes tell the rows apart; the first row of the null group is an empty text, and two rows are equal."""
    from tests.llm.conftest import SCHEMA

    rng = random.Random(5)
    rows = [(None, "", "a"), (None, None, "b"), (7, " ", "a")]
    rows += [(None if i % 3 == 0 else i % 20, " ".join(f"r{i}w{k}" for k in range(2 * i)), rng.choice(["a", "b", None])) for i in range(1, 120)]
    rows += [(3, "same text here", "b")] * 2 + [(None, "the same", "b")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_documents(df, block_words=8).toPandas()
    assert sorted(out["size"]) == sorted(len(words_of(t)) for _, t, _ in rows) and (out["taken"] <= 3 * out["size"]).all()
    assert out["doc_id"].isna().sum() == sum(i is None for i, *_ in rows)
    lone = {t: len(words_of(t)) for _, t, _ in rows if len(words_of(t)) > 3}
    taken = out.set_index("size")["taken"]
    plan = mixing.plan_mix(df.select("source", mixing.word_count(df["text"]).alias("size")), block_words=8)
    counted = collections.Counter()
    for p in mixing.mixed_text(df, plan).collect():
        words = p["text"].split(" ")
        counted[words[0].split("w")[0]] += len(words) if words[0].startswith("r") else 0
    assert all(taken[n] == counted[t.split("w")[0]] for t, n in lone.items())
    for name, target in zip(plan.names, plan.targets):
        sizes = [len(words_of(t)) for _, t, s in rows if s == name]
        assert abs(out.loc[out["size"].isin([n for n in sizes if n > 3]), "taken"].sum() - target) <= 16 + 3 * sum(n for n in sizes if n <= 3)
    copies = collections.Counter(r["text"] for r in mixing.mixed_documents(df, block_words=8).collect())
    assert copies[""] == copies[None] == copies[" "] == 1
    assert all(copies[t] in (taken[n] // n, -(-taken[n] // n)) for t, n in lone.items())
    assert sum(copies[t] * n for t, n in lone.items()) > 0.8 * sum(lone.values())


# ---------------------------------------------------------------- preference pairs

def preferences_text(turns):
    return "".join(f"<|{t['role']}|>\n{t['text']}<|end|>\n" for t in turns)


def test_common_prefix_is_rendered_once(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a = [turn("system", "s"), turn("user", "hi"), turn("assistant", "good"), turn("user", "ok"), turn("assistant", "bye")]
    b = [turn("system", "s"), turn("user", "hi"), turn("assistant", "bad")]
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, a, b), (2, b, b), (3, None, b), (4, [], []), (5, b, a[:2])], f"id int, chosen {kind}, rejected {kind}")
    rows = {r["id"]: r for r in preferences.format_preferences(pairs).collect()}
    r = rows[1]
    assert r["prompt_turns"] == 2 and r["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n" and r["rejected"] == "<|assistant|>\nbad<|end|>\n"
    trained = [r["chosen"][s["start"] : s["start"] + s["length"]] for s in r["chosen_spans"]]
    assert trained == ["good<|end|>\n", "bye<|end|>\n"]
    assert (rows[2]["chosen"], rows[2]["rejected"], rows[2]["prompt_turns"]) == ("", "", 3)
    assert rows[3]["prompt"] == "" and rows[3]["chosen"] == "" and rows[3]["rejected"] == preferences_text(b)
    assert rows[4]["prompt"] == "" and rows[4]["chosen_spans"] == []
    assert rows[5]["rejected"] == "" and rows[5]["prompt_turns"] == 2


def test_turns_are_ordered_and_nulls_defined(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (None, 1, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in preferences.collect_turns(turns).collect()}
    assert found == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], 2: [("unknown", "")], None: [("user", "x")]}
    pairs = {r["conv_id"]: r for r in preferences.echo_pairs(preferences.collect_turns(turns)).collect()}
    assert pairs[1]["rejected"][-1] == ("assistant", "a") and pairs[1]["chosen"][-1] == ("assistant", "b") and pairs[2]["chosen"] == pairs[2]["rejected"]
    assert preferences.format_preferences(preferences.echo_pairs(preferences.collect_turns(turns.limit(0)))).count() == 0


# ---------------------------------------------------------------- scores

def test_scores(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held_out = "pmod(crc32(cast(doc_id as string)), 7) = 2"
    from pyspark.sql import functions as F

    rows = lm_score.score_texts(df, RANKS, F.expr(held_out)).toPandas()
    texts = {r["doc_id"]: words_of((r["text"] or "").translate(ASCII_LOWER)) for r in df.collect()}
    counts = collections.Counter(w for i, t in texts.items() if fold(i, 7) != 2 for w in [*t, ""])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows.itertuples():
        t = [*texts[r.doc_id], ""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert r.n_tokens == len(t) and r.n_known == sum(counts[w] > 0 for w in t) and r.train_tokens == n and abs(base - r.base_score) < 1e-6 * abs(base)
        assert r.held_out == (fold(r.doc_id, 7) == 2) and math.isfinite(r.score) and r.score < 0
    got = {r["doc_id"]: r for r in lm_score.score_texts(odd, RANKS, F.expr(held_out)).collect()}
    assert len(got) == len(ODD) and got[1]["n_tokens"] == got[3]["n_tokens"] == 1 and got[1]["score"] == got[2]["score"] and got[7]["score"] == got[8]["score"]
    assert lm_score.score_texts(empty, RANKS, F.expr(held_out)).count() == 0
    untrained = lm_score.score_texts(odd, RANKS, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in untrained)


def toy_shares(rng, slots=12, classes=3):
    total = rng.integers(1, 50, slots)
    after = rng.random((slots + 1, slots + 1)).astype(np.float32)
    after /= after.sum(axis=1, keepdims=True)
    number = np.concatenate([np.arange(classes), rng.integers(0, classes, slots + 1 - classes)])
    return lm_score.shares_of(total, np.arange(slots, dtype=np.int32), np.append(total, 1), after, number, slots - 1)


def test_pieces_of_a_block_score_as_the_whole():
    rng = np.random.default_rng(0)
    words = np.array([3, 0, 400, 5, 0, 90, 1])
    block = lm_score.Block(
        0, np.arange(7), np.zeros(7, bool), np.ones(7, bool), words, rng.integers(0, 20, words.sum()).astype(np.int32), np.arange(20, dtype=np.uint64), np.ones(20, np.int64),
        rng.integers(0, 12, 40).astype(np.uint16), np.full(20, 2, np.int32))
    shares = toy_shares(rng)
    w = lm_score.first_weights(shares)
    stream, at = block.stream(shares.end)
    whole = lm_score.text_scores(w, shares, stream, at)
    for size in (1, 10, 100, 1000):
        pieces = list(block.pieces(size))
        assert [len(p.words) for p in pieces] == {1: [1] * 7, 10: [2, 1, 2, 1, 1], 100: [2, 1, 4], 1000: [7]}[size]
        assert np.concatenate([p.stream(shares.end)[0] for p in pieces]).tolist() == stream.tolist()
        assert np.concatenate([lm_score.text_scores(w, shares, *p.stream(shares.end)) for p in pieces]).tolist() == whole.tolist()


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    shares = toy_shares(rng)
    w = lm_score.first_weights(shares, width=4, window=5)
    flat = (w.flat() + rng.normal(0, 0.3, w.flat().shape)).astype(np.float64)
    window = rng.integers(0, 12, (6, 7))
    window[0, 5:] = -1
    mask = lm_score.causal_mask(5)
    _, grad = lm_score.gradient(w.filled(flat), shares, window, mask)
    for i in rng.choice(len(flat), 60, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-4
        slope = (lm_score.gradient(w.filled(flat + step), shares, window, mask)[0] - lm_score.gradient(w.filled(flat - step), shares, window, mask)[0]) / 2e-4
        assert abs(slope - grad[i]) < 2e-3 * max(1.0, abs(slope))


def test_each_subword_is_scored_once_and_causally():
    rng = np.random.default_rng(1)
    shares = toy_shares(rng)
    w = lm_score.first_weights(shares)
    w = w.filled((w.flat() + rng.normal(0, 0.3, w.flat().shape)).astype(np.float32))
    sizes = [1, 2, 5, lm_score.WINDOW, lm_score.WINDOW + 1, 3 * lm_score.WINDOW]
    at = np.cumsum([0, *sizes])
    stream = rng.integers(0, 12, at[-1])
    stream[at[1:] - 1] = shares.end
    whole = lm_score.text_scores(w, shares, stream, at)
    for i in range(len(sizes)):
        alone = lm_score.text_scores(w, shares, stream[at[i] : at[i + 1]], np.array([0, sizes[i]]))
        assert abs(alone[0] - whole[i]) < 1e-4 * abs(whole[i])


def test_training_counts_every_subword_once(spark):
    """Also in long texts and whatever the number of texts, and no subword of held-out ones."""
    from pyspark.sql import functions as F

    texts = [None, "a", " ".join(f"w{i}" for i in range(4000)), " ".join(["b c"] * 15), "held out words " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = df.select("id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), (F.col("id") != 4).alias("train")).toArrow()
    coder = lm_score.subwords(RANKS)

    class Sent:
        value = RANKS

    want, got, windows = collections.Counter(), collections.Counter(), 0
    for t in texts[:4]:
        want.update([*(coder.encoding.encode_ordinary(" " + " ".join(words_of(t))) if t else []), coder.end])
    for batch in lm_score._make_blocks(Sent)(rows.to_batches()):
        block = lm_score.Block.read(batch, 0)
        windows -= batch.column("windows")[0].as_py()
        for ids, counted in lm_score.training_windows(block, coder.end):
            windows += len(ids)
            got.update(ids[:, 2:][counted & (ids[:, 2:] >= 0)].tolist())
    assert got == want and windows == 0


def test_model_beats_pair_counts(spark):
    """Held-out texts of two made-up languages: attention tells the language, counts after one subword do not."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    tongues = [["ka", "so", "mi", "the", "re"], ["ka", "lu", "ve", "the", "do"]]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(60))) for i in range(300)]
    out = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, F.col("doc_id") % 7 == 2).toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() * 1.02


def test_large_attention_scores_give_the_same_shares():
    """Windows whose scores pass the range of exp, in a batch of several parts, against a plain softmax."""
    rng = np.random.default_rng(2)
    shares = toy_shares(rng)
    w = lm_score.first_weights(shares)
    w.query[...], w.key[...] = w.query * 60, w.key * 60
    window = rng.integers(0, 12, (lm_score.PART_WINDOWS + 3, lm_score.WINDOW + 2))
    last, before, mask = window[:, 1:-1], window[:, :-2], lm_score.causal_mask(lm_score.WINDOW)
    w.last[:4] *= 30
    with np.errstate(over="raise", invalid="raise"):
        weight = lm_score.forward(w, last, before, mask)[2]
    x = (w.last[last] + w.before[before] + w.place).astype(np.float64)
    plain = (x @ w.query) @ (x @ w.key).transpose(0, 2, 1) / 4 + mask
    assert np.abs(np.where(mask < 0, 0, plain)).max() > 200
    plain = np.exp(plain - plain.max(axis=2, keepdims=True))
    assert np.abs(weight - plain / plain.sum(axis=2, keepdims=True)).max() < 1e-3
    loss, small, touched = lm_score.touched_gradient(w, shares, window, mask)
    parts = [lm_score.touched_gradient(w, shares, window[i : i + 1], mask) for i in range(len(window))]
    assert abs(loss - np.mean([p[0] for p in parts])) < 1e-4 * loss
    assert np.allclose(small["classes"], np.mean([p[1]["classes"] for p in parts], axis=0), atol=1e-4) and touched["last"][0].tolist() == np.unique(last).tolist()


def test_readers_hold_one_block_at_a_time(spark, monkeypatch):
    """Blocks are megabytes long: a file of several has a row group for each."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from trendloom import runtime

    written = []
    monkeypatch.setattr(runtime, "shared_dir", lambda session, label, old=runtime.shared_dir: written.append(old(session, label)) or written[-1])
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 200)
    docs = spark.createDataFrame([(i, f"text number {i} of this table " * 5) for i in range(12)], "doc_id long, text string").coalesce(1)
    assert lm_score.score_texts(docs, RANKS, F.lit(False)).count() == 12
    files = [pq.ParquetFile(f).metadata for path in written if "/blocks-" in path for f in glob.glob(f"{path}/*.parquet")]
    assert any(m.num_rows > 1 for m in files) and all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.count()
        assert docs.columns[: len(columns)] == columns
    assert list(seen) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert before > seen["toxicity"] > seen["near_duplicates"] >= seen["decontamination"] > before * 0.7 and seen["mixing"] == seen["sharding"]
    assert docs.groupBy("shard").agg({"slot": "max", "*": "count"}).where("`max(slot)` + 1 <> `count(1)`").count() == 0
