"""Main text of web pages: block costs of a classifier, smoothed over the page by a minimum cut."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.html_blocks import FEATURES, Page, block_features, home, read_page
from trendloom.runtime import require

TRAINING_PAGES = 1_000
TRAINING_BLOCKS = 40_000
#: What the classifier believes before it has seen a page: long text with few links is content.
PRIOR = dict(
    chars=2.0, link_share=-4.0, stops=1.0, ends_sentence=0.5, heading=1.0, paragraph=1.0, item=-1.0, bare=-0.5, chars_before=0.5, chars_after=0.5, links_before=-0.5,
    links_after=-0.5, edge=-0.5, one=-1.5,
)
#: Costs in thousandths: bound of the classifier's log odds, markup evidence, edges between neighbours and inside an element.
CERTAIN, EVIDENCE, ADJACENT, PROXIMITY = 4_000, 6_000, 1_000, 500


@dataclass(frozen=True)
class BlockModel:
    """Weights of ``FEATURES``."""

    weights: np.ndarray

    def log_odds(self, rows: list[list[float]]) -> np.ndarray:
        return np.asarray(rows, dtype=float).reshape(-1, len(FEATURES)) @ self.weights


def prior_model() -> BlockModel:
    return BlockModel(np.array([PRIOR[f] for f in FEATURES]))


def fit(rows: np.ndarray, labels: np.ndarray, *, trust: float = 1.0, steps: int = 50) -> BlockModel:
    """Logistic regression that starts from, and is drawn towards, the prior weights (``trust`` = precision of the prior)."""
    start = prior_model().weights
    w = start.copy()
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) + trust * (w - start)
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + trust * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / (1e-12 + float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return BlockModel(w)


def minimum_cut(sources: list[int], sinks: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (the side of all nodes that residual paths reach).

    ``sources`` and ``sinks`` are the terminal capacities of each node,
    ``edges`` (u, v, capacity) hold in both directions; whole numbers.
    Maximum flow by blocking flows in level graphs.
    """
    n = len(sources)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(head))
        head.append(v)
        room.append(there)
        out[v].append(len(head))
        head.append(u)
        room.append(back)

    for v in range(n):
        direct = min(sources[v], sinks[v])  # flows straight through
        if sources[v] > direct:
            link(source, v, sources[v] - direct, 0)
        elif sinks[v] > direct:
            link(v, sink, sinks[v] - direct, 0)
    for u, v, capacity in edges:
        if u != v and capacity:
            link(u, v, capacity, capacity)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[v] >= 0 for v in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for i, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if not room[e])
                u = head[path[first] ^ 1]
                del path[first:]
                continue
            edges_out = out[u]
            while turn[u] < len(edges_out):
                e = edges_out[turn[u]]
                if room[e] and level[head[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(edges_out):
                path.append(e)
                u = head[e]
            elif u == source:
                break
            else:
                level[u] = -1
                u = head[path.pop() ^ 1]


def page_graph(page: Page, odds: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page: its blocks, then one node for each element they stand in.

    The source's capacity is what calling a block boilerplate costs, the
    sink's what calling it content costs.  Neighbours are tied the more the
    nearer they lie in the document tree; blocks of one element are tied
    through its node, and nodes of elements along the tree.
    """
    blocks, elements = page.blocks, page.elements
    sources, sinks = [], []
    for b, value in zip(blocks, np.clip(np.rint(odds * 1000), -CERTAIN, CERTAIN).astype(int).tolist(), strict=True):
        sources.append(max(value, 0) + (EVIDENCE if b.evidence > 0 else 0))
        sinks.append(max(-value, 0) + (EVIDENCE if b.evidence < 0 else 0))
    node: dict[int, int] = {}
    edges: list[tuple[int, int, int]] = []
    homes = [home(page, b) for b in blocks]
    for at in homes:
        while at not in node:
            node[at] = len(blocks) + len(node)
            if at == 0:
                break
            at = elements[at].parent
    sources += [0] * len(node)
    sinks += [0] * len(node)
    for at, own in node.items():
        if at:
            edges.append((own, node[elements[at].parent], PROXIMITY))
    for i, at in enumerate(homes):
        edges.append((i, node[at], PROXIMITY))
        if i:
            other, own, steps = homes[i - 1], at, 2
            while other != own:
                if elements[other].depth >= elements[own].depth:
                    other = elements[other].parent
                else:
                    own = elements[own].parent
                steps += 1
            edges.append((i - 1, i, 2 * ADJACENT // steps))
    return sources, sinks, edges


def content_blocks(page: Page, model: BlockModel) -> list[bool]:
    """Which blocks of the page are content."""
    if not page.blocks:
        return []
    return minimum_cut(*page_graph(page, model.log_odds(block_features(page.blocks))))[: len(page.blocks)]


def main_text(source: str, model: BlockModel) -> str:
    page = read_page(source)
    return "\n".join(b.text for b, kept in zip(page.blocks, content_blocks(page, model), strict=True) if kept)


def _labelled_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows, labels = [], [], []
        for key, source in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = read_page(source)
            for at, (block, row) in enumerate(zip(page.blocks, block_features(page.blocks), strict=True)):
                if block.evidence:
                    keys.append((key * 31 + at * 0x9E3779B1) & 0x7FFFFFFF)
                    rows.append(row)
                    labels.append(int(block.evidence > 0))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["key", "features", "label"])


def train_block_model(pages: DataFrame, *, html_col: str = "html", max_pages: int = TRAINING_PAGES, max_blocks: int = TRAINING_BLOCKS) -> BlockModel:
    """Learns to tell content from boilerplate by text and tags, from blocks that the markup itself labels.

    At most ``max_pages`` different pages, taken in the order of their
    hash, and at most ``max_blocks`` blocks of each label of theirs, taken in the order of theirs; cutting into
    blocks is done on the executors.  Null pages are left out; without any
    labelled block the prior weights hold.
    """
    require(max_pages > 0 and max_blocks > 0, "max_pages and max_blocks must be positive")
    key = F.xxhash64(F.col(html_col))
    known = pages.where(F.col(html_col).isNotNull())
    last = known.select(key.alias("key")).distinct().orderBy("key").limit(max_pages).agg(F.max("key")).first()[0]
    if last is None:
        return prior_model()
    sampled = known.where(key <= F.lit(last)).groupBy(key.alias("key")).agg(F.min(html_col).alias("html"))
    blocks = sampled.mapInArrow(_labelled_blocks, "key long, features array<double>, label int")
    rows = [r for label in (0, 1) for r in blocks.where(F.col("label") == label).orderBy("key", "features").limit(max_blocks).collect()]
    if not rows:
        return prior_model()
    return fit(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], dtype=float))


def extract_main_text(pages: DataFrame, model: BlockModel, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text and ``n_chars``, its number of code points.

    Blocks that a minimum cut calls content, in page order, joined by line
    feeds; white space inside a block is one space.  Null and empty pages
    give empty text, as do pages without content.  Every row stands by
    itself: ties and repeated rows give equal results.  Existing columns of
    the names of the results are replaced.
    """
    require(html_col != text_col, "html and text need names of their own")
    kept = pages.drop(*[c for c in (text_col, "n_chars") if c != html_col])
    own = "__html"
    source = kept.withColumn(own, F.coalesce(F.col(f"`{html_col}`"), F.lit("")))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(own)
            texts = [main_text(h, model) for h in batch.column(place).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != place]
            names = [n for i, n in enumerate(batch.schema.names) if i != place]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), sizes], names=[*names, text_col, "n_chars"])

    schema = kept.withColumn(text_col, F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return source.mapInArrow(extract, schema)
