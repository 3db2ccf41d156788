import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import ODD
from trendloom.llm import substring_dedup
from trendloom.llm.run_index import RunIndex


def brute(rows, match=50):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - match + 1):
            s = raw[i : i + match]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - match + 1):
            if first[raw[i : i + match]] < doc_id:
                gone[i : i + match] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in substring_dedup.repeated_bytes(df, **options).collect())


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        refs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        pats = [[rng.randint(1, 4) for _ in range(rng.randint(1, 15))] for _ in range(4)]
        index = RunIndex(np.array([x for r in refs for x in [*r, 0]]), np.cumsum([0] + [len(r) + 1 for r in refs])[:-1])
        got = index.matching_statistics(np.array([x for p in pats for x in p]), np.cumsum([0] + [len(p) for p in pats])[:-1], np.array([len(p) for p in pats]))
        want = [max(n for n in range(len(p) - i + 1) if n == 0 or any(p[i : i + n] == r[j : j + n] for r in refs for j in range(len(r)))) for p in pats for i in range(len(p))]
        assert got.tolist() == want


def shared_pieces(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    pieces = [" ".join(word() for _ in range(rng.randint(4, 25))) for _ in range(12)]
    return [" ".join(rng.choice(pieces)[rng.randint(0, 20) :] if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 512), (3, 3), (4, 0)])
def test_equals_brute_force(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(substring_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    texts = shared_pieces(seed)
    texts += texts[:5] + ["ab" * 400, "ab" * 300 + "c", "q" * 49, "q" * 50, "q" * 51]
    assert found(docs(texts)) == brute(list(enumerate(texts)))


def test_many_copies_are_dealt_by_id(docs):
    texts = [("one sentence that everybody copies word by word, " * 3)] * 90 + ["an own text of its author that nobody has copied so far, I hope"]
    assert found(docs(texts)) == brute(list(enumerate(texts)))


def test_odd_rows(odd, empty):
    assert found(odd) == brute([r[:2] for r in ODD])
    assert found(empty) == []


def test_rows_without_or_with_equal_ids(spark):
    text = "the same text of more than fifty bytes stands in each of these rows"
    df = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (6, text)], "doc_id long, text string")
    removed = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.repeated_bytes(df).collect())
    assert removed == [(-1, 0), (-1, 0), (5, 0), (5, 0), (6, len(text))]


def test_kept_bytes_are_the_named_ones(docs):
    df = docs(shared_pieces(9, 20))
    named = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.repeated_bytes(df).collect()}
    assert {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in substring_dedup.kept_bytes(df).collect()} == named
