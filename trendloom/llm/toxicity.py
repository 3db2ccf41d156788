"""Toxicity: a linear classifier on words whose scores must not move when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.textbytes import IS_BREAK, LOWER, slices, span_hashes, text_of, word_spans
from trendloom.runtime import cut_lineage

#: Identity terms and the term each is swapped with (both ways).
SWAPS = """
he she, him her, his hers, himself herself, man woman, men women, boy girl, boys girls, male female, father mother, son daughter, brother sister,
husband wife, gay straight, lesbian heterosexual, transgender cisgender, black white, asian european, african american, mexican canadian,
chinese japanese, arab latino, muslim christian, muslims christians, jewish hindu, jew catholic, jews catholics, buddhist atheist, islam christianity,
immigrant citizen, immigrants citizens, refugee native, old young, deaf hearing, blind sighted, disabled able,
il elle, homme femme, hommes femmes, garçon fille, père mère, musulman chrétien, musulmans chrétiens, juif catholique, noir blanc, arabe européen,
hombre mujer, hombres mujeres, niño niña, padre madre, musulmán cristiano, judío católico, negro blanco, árabe europeo,
mann frau, männer frauen, junge mädchen, vater mutter, muslim christ, jude katholik, schwarzer weißer, araber europäer
"""

TRAINING_ROWS = 12_000


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of every word, lower case, punctuation cut off."""
    data = LOWER[data]
    starts, ends = word_spans(data, at, IS_BREAK)
    return text_of(starts, at), span_hashes(data, starts, ends)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return span_hashes(LOWER[np.frombuffer(b"".join(raw), np.uint8)], at[:-1], at[1:])


def swap_table(swaps: str = SWAPS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes of identity terms and the hashes of their counterparts."""
    pairs = [p.split() for p in swaps.replace("\n", " ").split(",")]
    table: dict[str, str] = {}
    for a, b in pairs:
        table.setdefault(a, b)
        table.setdefault(b, a)
    own, other = _hash_words(list(table)), _hash_words(list(table.values()))
    order = np.argsort(own)
    return own[order], other[order]


def _lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is a key, its place among the sorted keys)."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by word hash (sorted) and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        texts = len(at) - 1
        number, value = _word_hashes(data, at)
        known, place = _lookup(self.words, value)
        pairs = np.unique(number[known] * len(self.words) + place[known])
        sums = np.bincount(pairs // max(1, len(self.words)), weights=self.weights[pairs % max(1, len(self.words))] if len(self.words) else None, minlength=texts)[:texts]
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.intercept, -40, 40)))


@dataclass(frozen=True)
class Design:
    """Rows of ones, or of the given entries, in sparse form."""

    row: np.ndarray
    column: np.ndarray
    rows: int
    columns: int
    entry: np.ndarray | None = None

    @staticmethod
    def of(cells: list[np.ndarray], columns: int, minus: list[np.ndarray] | None = None) -> Design:
        """Ones at each row's ``cells`` and, if given, minus ones at its ``minus``."""
        parts = [cells] if minus is None else [cells, minus]
        row = np.concatenate([np.repeat(np.arange(len(p), dtype=np.int32), [len(c) for c in p]) for p in parts])
        column = np.concatenate([np.zeros(0, np.int32), *(c for p in parts for c in p)])
        entry = None if minus is None else np.repeat([1.0, -1.0], [sum(len(c) for c in p) for p in parts])
        return Design(row, column, len(cells), columns, entry)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column] if self.entry is None else w[self.column] * self.entry, minlength=self.rows)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=v[self.row] if self.entry is None else v[self.row] * self.entry, minlength=self.columns)


def chosen_words(words: np.ndarray, n: np.ndarray, toxic: np.ndarray, base: float, max_words: int = 4000) -> np.ndarray:
    """Of the sorted ``words``, in ``n`` texts with labels that sum to ``toxic``, the ``max_words`` that tell the labels apart best."""
    expected = n * base
    strength = np.abs(toxic - expected) / np.sqrt(expected * (1 - base) + 1e-9)
    return words[np.sort(np.argsort(-strength, kind="stable")[:max_words])]


def fit(*rows, **options) -> ToxicityModel:
    """A model of rows at hand: ``keys, x, swap, labels`` as :func:`fit_design` takes them, or ``texts, swapped, labels`` as :func:`fit_texts` does."""
    return (fit_design if len(rows) == 4 else fit_texts)(*rows, **options)


def fit_texts(texts: list[np.ndarray], swapped: list[np.ndarray], labels: np.ndarray, *, min_rows: int = 5, max_words: int = 4000, **options) -> ToxicityModel:
    """:func:`fit_design` over the words of the texts.

    ``texts[i]`` holds the distinct word hashes of a labelled text, ``swapped[i]``
    those after its identity terms are swapped.  Words are candidates from ``min_rows`` texts on.
    """
    labels, lengths = labels.astype(float), [len(t) for t in texts]
    words, place, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_inverse=True, return_counts=True)
    toxic, often = np.bincount(place, weights=np.repeat(labels, lengths), minlength=len(words)), n >= min_rows
    keys = chosen_words(words[often], n[often], toxic[often], _share(labels.sum(), len(labels)), max_words)
    places = _places(keys)
    has, lost, gained = ([places(w) for w in side] for side in (
        texts, [np.setdiff1d(w, o) for w, o in zip(texts, swapped, strict=True)], [np.setdiff1d(o, w) for w, o in zip(texts, swapped, strict=True)]))
    return fit_design(keys, Design.of(has, len(keys)), Design.of(lost, len(keys), gained), labels, **options)


def _places(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Words to the places among ``keys`` of those that are there."""

    def places(words: np.ndarray) -> np.ndarray:
        known, at = _lookup(keys, words)
        return at[known].astype(np.int32)

    return places


def fit_design(keys: np.ndarray, x: Design, swap: Design, labels: np.ndarray, *, sparsity: float = 2e-4, fairness: float = 1.0, steps: int = 300) -> ToxicityModel:
    """Logistic regression on the presence of words, with an L1 penalty and a counterfactual penalty.

    ``x`` holds which of the words ``keys`` a labelled text has, ``swap`` what
    that loses (1) and gains (-1) when its identity terms are swapped.  The second penalty is
    ``fairness`` times the mean squared difference of the two scores before
    the logistic function.
    """
    rows, intercept = len(labels), _log_odds(labels.sum(), len(labels))
    if not len(keys):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), intercept)
    w, b = np.zeros(len(keys)), intercept
    look_w, look_b, momentum = w, b, 1.0
    # Step size from a bound of the curvature, by power iteration over both penalties.
    v = np.random.default_rng(0).random(len(keys))
    for _ in range(20):
        u = x.transposed_times(x.times(v)) / (4 * rows) + 2 * fairness * swap.transposed_times(swap.times(v)) / rows
        norm = np.linalg.norm(u)
        if norm == 0:
            break
        v = u / norm
    step = 1.0 / (1.1 * norm + 0.26)
    for _ in range(steps):
        score = 1.0 / (1.0 + np.exp(-np.clip(x.times(look_w) + look_b, -40, 40)))
        slope = x.transposed_times(score - labels) / rows + 2 * fairness * swap.transposed_times(swap.times(look_w)) / rows
        new_w = look_w - step * slope
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * sparsity, 0)
        new_b = look_b - step * float((score - labels).mean())
        new_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_w = new_w + (momentum - 1) / new_momentum * (new_w - w)
        look_b = new_b + (momentum - 1) / new_momentum * (new_b - b)
        w, b, momentum = new_w, new_b, new_momentum
    used = w != 0
    return ToxicityModel(keys[used], w[used], float(b))


def _share(toxic: float, rows: int) -> float:
    return (toxic + 0.5) / (rows + 1.0)


def _log_odds(toxic: float, rows: int) -> float:
    return float(np.log(_share(toxic, rows) / (1 - _share(toxic, rows))))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word hashes of each labelled text, and of its counterfactual if that differs."""
    own, other = swap_table()
    for batch in batches:
        for part, data, at in slices(batch, "text"):
            number, value = _word_hashes(data, at)
            identity, place = _lookup(own, value)
            flipped = np.where(identity, other[place], value)
            edges = np.searchsorted(number, np.arange(len(at)))
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            changed = [identity[s:e].any() for s, e in spans]
            columns = [pa.array([np.unique(value[s:e]).tobytes() for s, e in spans], pa.binary()), pa.array([np.unique(flipped[s:e]).tobytes() if c else None for (s, e), c in zip(spans, changed, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), *columns], names=["order", "label", "words", "swapped"])


def _hashes(cells: pa.Array) -> list[np.ndarray]:
    """The word hashes of each cell; views, nothing is copied."""
    return [np.frombuffer(c.as_buffer(), np.uint64) if c.is_valid else np.zeros(0, np.uint64) for c in cells]


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a batch each word is, and the sum of their labels."""
    for batch in batches:
        words = _hashes(batch.column("words"))
        if sum(map(len, words)):
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False).astype(float), [len(w) for w in words])
            counts = [np.bincount(place, minlength=len(distinct)), np.bincount(place, weights=label, minlength=len(distinct))]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "n", "toxic"])


def _cells(keys: np.ndarray):
    """Places among ``keys`` of a text's words, and of those it loses and gains by the swap."""
    find = _places(keys)

    def places(words: np.ndarray) -> bytes:
        return find(words).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, swapped = _hashes(batch.column("words")), _hashes(batch.column("swapped"))
            changed = batch.column("swapped").is_valid().to_numpy(zero_copy_only=False)
            lost = [places(np.setdiff1d(w, o, assume_unique=True)) if c else b"" for w, o, c in zip(words, swapped, changed, strict=True)]
            gained = [places(np.setdiff1d(o, w, assume_unique=True)) if c else b"" for w, o, c in zip(words, swapped, changed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), *(pa.array(c, pa.binary()) for c in ([places(w) for w in words], lost, gained))], names=["order", "label", "has", "lost", "gained"])

    return run


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAINING_ROWS, min_rows: int = 5, max_words: int = 4000, **options) -> ToxicityModel:
    """Fits a model on at most ``max_rows`` labelled texts, taken in the order of their id's hash.

    Ids decide the sample before any text is read (rows that share an id go
    together).  Words are cut out and counted on the executors; words in ``min_rows`` texts or more are
    candidates, of which :func:`chosen_words` takes ``max_words``, and of each text only the places of these reach the
    driver.  Rows without label are left out; null texts have no words.  Without any
    label the model gives every text the same score.
    """
    known = labelled.where(F.col(label_col).isNotNull())
    order = F.xxhash64(id_col)
    last = known.select(order.alias("order")).distinct().orderBy("order").limit(max_rows).agg(F.max("order").alias("last")).first()["last"]
    sampled = known if last is None else known.where(order <= F.lit(last))
    texts = sampled.select(order.alias("order"), F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    features = cut_lineage(texts.mapInArrow(_features, "order long, label int, words binary, swapped binary"), "features")
    total = features.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    counted = features.select("label", "words").mapInArrow(_word_counts, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    table = counted.where(F.col("n") >= min_rows).toArrow()
    words = table.column("word").to_numpy().view(np.uint64)
    by_word = np.argsort(words)
    keys = chosen_words(words[by_word], *(table.column(c).to_numpy()[by_word].astype(float) for c in ("n", "toxic")), _share(total["toxic"], total["rows"]), max_words)
    rows = features.mapInArrow(_cells(keys), "order long, label int, has binary, lost binary, gained binary").toArrow().sort_by("order")
    has, lost, gained = ([np.frombuffer(c.as_buffer(), np.int32) for c in rows.column(name)] for name in ("has", "lost", "gained"))
    return fit(keys, Design.of(has, len(keys)), Design.of(lost, len(keys), gained), rows.column("label").to_numpy().astype(float), **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows of ``docs`` with a score between 0 and 1; null and empty texts get the intercept's score.

    Whole texts count, every word once.  The model is a few thousand weights
    at most and travels with the task.  An existing score column is replaced.
    """
    kept = docs.drop(score_col)
    text = "__text"
    source = kept.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, text):
                columns = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != text]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.scores(data, at), pa.float64())], names=[*(n for n in part.schema.names if n != text), score_col])

    schema = kept.withColumn(score_col, F.lit(0.0)).schema
    return source.mapInArrow(score, schema)


def hash_fold(id_col: Column, folds: int = 4) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))
