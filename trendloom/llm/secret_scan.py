"""Secret scan: candidate strings, and a random forest that removes the false findings."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_FINDINGS = 20_000
NEIGHBOUR_BUCKETS = 16

#: Words that name a secret, path parts that speak against one.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "private", "access")
DUMMY_PARTS = ("test", "tests", "example", "examples", "sample", "mock", "fixture", "fixtures", "doc", "docs", "demo")

#: A run of twelve or more key characters, or an assignment; :func:`candidates` decides which count.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?P<run>[A-Za-z0-9+/_-]{12,}+)|[=:]\s{0,2}[ \t]*+(?P<quote>[\"']?)")
#: What is assigned, six characters at least: in quotes up to the closing one in the line, or else up to white space or a quote,
#: and without quotes also up to the next assignment of a list.
CLOSED = {'"': re.compile(r'[^"\r\n]{6,}+(?=")'), "'": re.compile(r"[^'\r\n]{6,}+(?=')")}
QUOTED = re.compile(r"[^\s\"']{6,}+")
PLAIN = re.compile(r"(?:[^\s\"'&;,?#|]|[&;,?#|](?!(?:amp;)?[\w.\[\]-]{1,64}+[=:])){6,}+")
MIXED = re.compile(r"\d|[a-z0-9+/_-][A-Z]")
WORD = re.compile(r"[^\W_]+")
CLASSES = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
KINDS = "aA0."
FEATURES = 3 + 16 + 3 + 1 + 2 + 2 + 2 * NEIGHBOUR_BUCKETS


def load_dictionary(path: str, shortest: int = 3, longest: int = 16) -> frozenset[str]:
    """Whole words of a public tokenizer's vocabulary: lower-case letters only."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = "</w>"
    return frozenset(w for k in vocabulary if k.endswith(ends) and (w := k[: -len(ends)]).isalpha() and shortest <= len(w) <= longest)


def dictionary_coverage(text: str, words: frozenset[str], shortest: int = 3, longest: int = 16) -> float:
    """Share of characters that dictionary words cover, taking the longest word from left to right."""
    low, at, covered = text.lower(), 0, 0
    while at < len(low):
        for n in range(min(longest, len(low) - at), shortest - 1, -1):
            if low[at : at + n] in words:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % NEIGHBOUR_BUCKETS


def features(candidate: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    """Length, entropy, character transitions, dictionary coverage, path and neighbouring words."""
    kinds = "".join(k if k in KINDS else "." for k in candidate.translate(CLASSES))
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    moves = max(1, len(kinds) - 1)
    counts = Counter(candidate)
    entropy = -sum(n / len(candidate) * math.log2(n / len(candidate)) for n in counts.values())
    left, right = WORD.findall(before.lower()), WORD.findall(after.lower())
    parts = WORD.findall(path.lower())
    named = any(k in w for w in left[-2:] for k in KEY_WORDS)
    sides = [0.0] * (2 * NEIGHBOUR_BUCKETS)
    for w in left[-2:]:
        sides[_bucket(w)] = 1.0
    for w in right[:1]:
        sides[NEIGHBOUR_BUCKETS + _bucket(w)] = 1.0
    return [
        float(len(candidate)), entropy, len(counts) / len(candidate),
        *(steps[a, b] / moves for a in KINDS for b in KINDS),
        *(kinds.count(k) / len(kinds) for k in "aA0"),
        dictionary_coverage(candidate, words),
        float(named), float(before.rstrip("\"' ").endswith(("=", ":"))),
        float(any(p in DUMMY_PARTS for p in parts)), float(before.endswith(("/", "@", "."))),
        *sides,
    ]


def key_name(text: str, end: int) -> str:
    """The whole name that stands before ``end``, without a quote and white space after it."""
    while end and text[end - 1] in " \t":
        end -= 1
    for _ in range(2):
        end -= bool(end and text[end - 1] in "\r\n")
    end -= bool(end and text[end - 1] in "\"'")
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return text[start:end]


def names_secret(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in KEY_WORDS)


def assigned(text: str, at: int, quote: str) -> re.Match | None:
    """The value that begins at ``at``, after an opening ``quote`` if there is one."""
    if not quote:
        return PLAIN.match(text, at)
    return CLOSED[quote].match(text, at) or QUOTED.match(text, at)


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, string): values that a named key is given, and key-like runs with a digit or with capitals after the first.

    What an unnamed key is given is scanned like all other text, so assignments
    inside it (URLs, connection strings) count by their own keys.
    """
    at = 0
    while m := CANDIDATE.search(text, at):
        at = m.end()
        if m["run"] is not None:
            if MIXED.search(m["run"]):
                yield m.start(), m["run"]
        elif names_secret(key_name(text, m.start())) and (value := assigned(text, at, m["quote"])):
            yield at, value[0]
            at = value.end()


def find_candidates(docs: DataFrame, dictionary: frozenset[str], *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", context: int = 48) -> DataFrame:
    """(``id_col``, start, candidate, before, after, path, features): every candidate of every whole text.

    ``start`` counts characters; ``before`` and ``after`` are the neighbouring
    ``context`` characters.  Null texts have no candidates, a null path is
    empty.  Texts are read in place, nothing is shuffled.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(dictionary)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("__path"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text, path = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                for start, found in candidates(text):
                    end = start + len(found)
                    before, after = text[max(0, start - context) : start], text[end : end + context]
                    out.append((i, start, found, before, after, path, features(found, before, after, path, words)))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:6]), pa.array(columns[6], pa.list_(pa.float64()))],
                    names=["__id", "start", "candidate", "before", "after", "path", "features"])

    schema = f"__id {rows.schema['__id'].dataType.simpleString()}, start int, candidate string, before string, after string, path string, features array<double>"
    return rows.mapInArrow(scan, schema).withColumnRenamed("__id", id_col)


def rule_labels(findings: DataFrame) -> DataFrame:
    """Labels findings that well-known formats and key names decide; the others stay null.

    1: cloud key ids of the documented form, and values of twelve or more hex
    or key characters with a digit that a password, token or secret is set to.
    0: digits only, dates and numbers, runs of letters.
    """
    value = F.col("candidate")
    key = F.rlike(F.col("before"), F.lit(r"(?i)(password|passwd|pwd|secret|token|api_?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?$"))
    yes = F.rlike(value, F.lit("^AKIA[A-Z0-9]{16}$")) | (key & F.rlike(value, F.lit(r"^(?=.*\d)[A-Za-z0-9+/_.-]{12,}$")))
    no = F.rlike(value, F.lit(r"^[0-9+/_-]+$")) | F.rlike(value, F.lit(r"^[^0-9]*$"))
    return findings.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def train_forest(labelled: DataFrame, *, label_col: str = "label", max_findings: int = TRAINING_FINDINGS, trees: int = 30, depth: int = 8, seed: int = 0) -> RandomForestClassificationModel | None:
    """A forest from labelled findings, at most ``max_findings`` of each label in the order of their hash.

    Equal findings (same string, neighbourhood and path) count once, so a line
    that many documents share cannot fill the sample.
    Without findings of both labels there is nothing to learn and no model.
    """
    known = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double").alias("label"), array_to_vector("features").alias("vector"), F.xxhash64("candidate", "before", "after", "path").alias("order"))
    known = known.dropDuplicates(["label", "order"])
    parts = [known.where(F.col("label") == c).orderBy("order").limit(max_findings) for c in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1]).drop("order").cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed).fit(sample)
    finally:
        sample.unpersist()


def filter_findings(findings: DataFrame, forest: RandomForestClassificationModel | None, *, threshold: float = 0.5) -> DataFrame:
    """All findings with ``score`` (the forest's share for a true secret) and ``is_secret``; without a forest nothing is removed."""
    if forest is None:
        return findings.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    vectors = findings.withColumn("vector", array_to_vector("features"))
    scored = forest.setFeaturesCol("vector").transform(vectors).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("is_secret", F.col("score") >= threshold).drop("vector", "rawPrediction", "probability", "prediction")
