"""Mixing sources to target weights: packed token blocks, multinomial shards, index permutations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.textbytes import mix
from trendloom.runtime import cut_lineage, require

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKETS = 1024
MAX_SOURCES = 100_000
#: Columns that tell rows apart whatever their ids: a number of its own, the hash of what it holds, its rank among rows of that hash.
ROW, HASH, RANK = "__row", "__hash", "__rank"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_start(df: DataFrame, group: Sequence[str], size: str, order: Sequence[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds where each row begins when the rows of its group are laid end to end.

    The order is by bucket of the hash of ``order``, then by ``order``.  Buckets
    are summed first, so a group of any size is numbered by many tasks.
    """
    bucket, base, inner = "__bucket", "__base", "__inner"
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)))
    sums = dealt.groupBy(*group, bucket).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn(inner, F.coalesce(F.sum(size).over(within), F.lit(0)))
    return laid.join(starts, [*group, bucket]).withColumn(name, F.col(base) + F.col(inner)).drop(bucket, base, inner)


@dataclass(frozen=True)
class Plan:
    """What the mix takes of each source: one entry per source, in code point order with null last."""

    names: tuple[str | None, ...]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    block_words: int
    shard_slots: int
    seed: int

    def frame(self, spark) -> DataFrame:
        rows = [(n, i, int(z), float(t), int(b), int(s)) for i, (n, z, t, b, s) in enumerate(zip(self.names, self.sizes, self.targets, self.blocks, self.slots, strict=True))]
        return spark.createDataFrame(rows, "__name string, __source int, source_size long, target double, blocks long, slots long")


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, max_repeats: float) -> np.ndarray:
    """Shares of ``total`` by weight; none above ``max_repeats`` times its size, the excess reshared by weight."""
    caps = max_repeats * sizes.astype(float)
    capped = np.zeros(len(sizes), dtype=bool)
    while True:
        free = weights * ~capped
        share = (total - caps[capped].sum()) * free / free.sum() if free.sum() else free
        over = ~capped & (share > caps)
        if not over.any():
            return np.where(capped, caps, share)
        capped |= over


def plan_mix(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), *, max_repeats: int = 3, block_words: int = 32, shard_slots: int = 4096, seed: int = 0) -> Plan:
    """Plans a mix from (``source``, ``size``) rows; ``weights`` go round the sources in code point order, null last.

    Only one row per source reaches the driver, at most ``MAX_SOURCES``; more are refused.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    require(len(per_source) <= MAX_SOURCES, f"more than {MAX_SOURCES} sources")
    rows = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    size = np.array([r["size"] for r in rows], dtype=np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(rows))], dtype=float)
    target = capped_targets(size, weight, float(size.sum()), max_repeats) if size.sum() else np.zeros(len(size))
    blocks = -(-size // block_words)
    epochs = np.minimum(np.floor(target / np.maximum(size, 1)), max_repeats).astype(np.int64)
    rest = np.rint((target - epochs * size) / block_words).astype(np.int64)
    slots = np.where(size > 0, np.minimum(epochs * blocks + np.clip(rest, 0, blocks), max_repeats * blocks), 0)
    return Plan(tuple(r["source"] for r in rows), size, target, blocks, slots, block_words, shard_slots, seed)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 chosen by ``key``: a Feistel network, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
        while todo.any():
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def shard_draws(spark, plan: Plan) -> DataFrame:
    """(shard, source, count, start): multinomial counts per shard, and where they start among their source's draws."""
    total = int(plan.slots.sum())
    shares = plan.slots / max(total, 1)
    full, seed = plan.shard_slots, plan.seed

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(full, total - shard * full)
                counts = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, shares)
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": np.full(len(hit), shard), "source": hit.astype(np.int32), "count": counts[hit]})

    shards = spark.range(-(-total // full)).mapInPandas(draw, "shard long, source int, count long")
    return running_start(shards, ["source"], "count", ["shard"], "start")


def mixed_slots(spark, plan: Plan) -> DataFrame:
    """The mix as (shard, position, source, block): every slot of every output shard and the block it takes.

    Draws beyond a source's planned slots go to sources drawn too seldom, in
    order, so each source gets exactly its planned slots while shards keep
    their sizes.  A source's slots run through permutations of its block
    indexes, a new one per pass, so no block comes more than one time more
    often than another.  ``position`` orders the slots of a shard.
    """
    draws = shard_draws(spark, plan)
    drawn = np.zeros(len(plan.slots), dtype=np.int64)
    for r in draws.groupBy("source").agg(F.sum("count").alias("n")).collect():  # one row per source
        drawn[r["source"]] = r["n"]
    surplus, deficit = np.maximum(drawn - plan.slots, 0), np.maximum(plan.slots - drawn, 0)
    surplus_from, deficit_to = np.cumsum(surplus) - surplus, np.cumsum(deficit)
    blocks, slots, seed = plan.blocks, plan.slots, plan.seed

    def ranges(shard: int, source: int, count: int, start: int) -> Iterator[tuple[int, int, int]]:
        kept = int(min(max(slots[source] - start, 0), count))
        if kept:
            yield source, start, kept
        free, left = int(surplus_from[source] + max(start - slots[source], 0)), count - kept
        while left:
            to = int(np.searchsorted(deficit_to, free, side="right"))
            take = int(min(left, deficit_to[to] - free))
            yield to, int(drawn[to] + free - (deficit_to[to] - deficit[to])), take
            free, left = free + take, left - take

    def expand(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch[["shard", "source", "count", "start"]].itertuples(index=False):
                for source, first, count in ranges(*map(int, row)):
                    index = np.arange(first, first + count)
                    block = np.empty(count, dtype=np.int64)
                    for epoch in np.unique(index // blocks[source]):
                        here = index // blocks[source] == epoch
                        block[here] = permuted(index[here] % blocks[source], int(blocks[source]), hash((seed, source, int(epoch))))
                    with np.errstate(over="ignore"):
                        position = mix(index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(hash((seed, source, -1)) & (2**64 - 1)))
                    yield pd.DataFrame({"shard": np.full(count, row[0]), "position": position.astype(np.int64), "source": np.full(count, source, dtype=np.int32), "block": block})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return draws.repartition(n, "shard", "source").mapInPandas(expand, "shard long, position long, source int, block long")


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with a number of their own (``ROW``), written so that it stays."""
    return cut_lineage(docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias(ROW)), "rows")


def sized_rows(rows: DataFrame, row: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(``id_col``, source, size, ``ROW``, ``HASH``, ``RANK``) of every row, numbered by ``row``.

    Words are counted once; everything later reads the counts.  Hash and rank
    are a key that does not depend on where a row is read: only rows with equal
    id, source and text can change places.
    """
    counted = cut_lineage(rows.select(
        id_col, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias(ROW), F.xxhash64(id_col, source_col, text_col).alias(HASH)), "counts")
    return cut_lineage(running_start(counted.withColumn("__one", F.lit(1)), [HASH], "__one", [ROW], RANK).drop("__one"), "sizes")


def packed_pieces(sized: DataFrame, plan: Plan) -> DataFrame:
    """(source, block, ``ROW``, first, words): which words of a row lie in which block of its source's stream."""
    sources = F.broadcast(plan.frame(sized.sparkSession).select("__name", "__source"))
    laid = running_start(
        sized.where("size > 0").join(sources, F.col("source").eqNullSafe(F.col("__name"))).select(ROW, HASH, RANK, F.col("__source").alias("source"), F.col("size").alias("__size")),
        ["source"], "__size", [HASH, RANK], "__start")
    n = plan.block_words
    begin, end = F.greatest("__start", F.col("block") * n), F.least(F.col("__start") + F.col("__size"), (F.col("block") + 1) * n)
    covered = laid.withColumn("block", F.explode(F.sequence(F.expr(f"__start div {n}"), F.expr(f"(__start + __size - 1) div {n}"))))
    return covered.select("source", "block", ROW, (begin - F.col("__start")).alias("first"), (end - begin).alias("words"))


def taken_rows(sized: DataFrame, weights: Sequence[float], **options) -> DataFrame:
    """The rows of ``sized`` with source_size, target and taken."""
    plan = plan_mix(sized, weights, **options)
    spark = sized.sparkSession
    times = mixed_slots(spark, plan).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = packed_pieces(sized, plan)
    # The planner takes the slots for as few as the shards they were drawn for; their number grows with the words.
    taken = pieces.join(times.hint("merge"), ["source", "block"]).groupBy(ROW).agg(F.sum(F.col("words") * F.col("times")).alias("__taken"))
    sources = F.broadcast(plan.frame(spark).select("__name", "source_size", "target"))
    named = sized.join(sources, F.col("source").eqNullSafe(F.col("__name")))
    return named.join(taken, ROW, "left").withColumn("taken", F.coalesce("__taken", F.lit(0)).cast("long"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(``id_col``, size, source_size, target, taken): how many words of each document a mix takes, repeats counted.

    Words of a source are packed into blocks of ``block_words`` in an order
    only ids, sources and texts decide; output shards of ``shard_slots`` blocks
    draw multinomial counts per source, and each slot takes the block its
    source's permutation names.  A row's ``taken`` sums its words in the slots'
    blocks and never exceeds ``max_repeats`` times its size.  Null texts and
    texts without words have size 0 and nothing taken; null is a source of its
    own.  Every row counts for itself, whether its id is null or repeated.
    Reruns agree.
    """
    sized = sized_rows(docs, F.monotonically_increasing_id(), id_col, text_col, source_col)
    return taken_rows(sized, weights, **options).select(id_col, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: whole passes, and the rest by a draw on the row's hash and rank.

    A row whose words are taken t times on average comes floor(t) or ceil(t)
    times, so sources keep their target shares; one without words comes once
    (no share of words decides about it).  Null and repeated ids count row by row.
    """
    rows = numbered(docs, *docs.columns)
    mixed = taken_rows(sized_rows(rows, F.col(ROW), id_col, text_col, source_col), weights, seed=seed, **options)
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), HASH, RANK), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + draw))
    often = mixed.select(ROW, copies.cast("int").alias("__copies")).where("__copies > 0")
    repeated = rows.join(often, ROW)
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_text(docs: DataFrame, plan: Plan, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (shard, position, source, block, ``id_col``, first, text), the pieces of each slot's block in order of (position, id, first)."""
    rows = numbered(docs, id_col, text_col, source_col)
    pieces = packed_pieces(sized_rows(rows, F.col(ROW), id_col, text_col, source_col), plan)
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    texts = pieces.join(rows.select(ROW, id_col, words.alias("__split")), ROW)
    cut = texts.select("source", "block", id_col, "first", F.array_join(F.slice("__split", F.col("first").cast("int") + 1, F.col("words").cast("int")), " ").alias("text"))
    return mixed_slots(docs.sparkSession, plan).hint("merge").join(cut, ["source", "block"]).select("shard", "position", "source", "block", id_col, "first", "text")
