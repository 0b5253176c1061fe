"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.llm.scratch import keep

#: Rows, and bytes of their strings, which one task puts in order in the last permutation.
ORDERED_ROWS, ORDERED_BYTES = 20_000, 64 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: inversion over the values within 14 standard deviations of the
    mode, whose weights follow from each other by exact ratios. Any population size; outside lies less than 1e-40."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    p = good / total
    spread = int(14 * (draws * p * (1 - p) * (total - draws) / max(1, total - 1)) ** 0.5) + 20
    mode = (draws + 1) * (good + 1) // (total + 2)
    a, b = max(lo, mode - spread), min(hi, mode + spread)
    k = np.arange(a, b, dtype=float)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def matrix(blocks: list[int], shards: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows from each block to each shard, as a uniform shuffle has them; rows sum to ``blocks``, columns to ``shards``."""
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, n in enumerate(blocks):
        rest = sum(left)
        for j, room in enumerate(left):
            out[i, j] = hypergeometric(rng, room, rest - room, n)
            n -= int(out[i, j])
            rest -= room
            left[j] -= int(out[i, j])
    return out


def shuffle(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """``docs``, all columns as they are, after two columns __shard and __slot: a uniform permutation of all rows.

    Shards' row counts are at most one apart, slots gapless from 0. Rows are written once in the blocks in which they
    are read; the driver draws how many rows each block gives each shard (blocks x shards numbers, however many rows),
    every task permutes its rows and deals them out by those counts, and after the exchange each shard is put in
    random order, in as many parts as its rows need. A row's place depends on the seed and on its block and place
    there, which the written table holds, so tasks run anew give the same. Nulls, repeated rows and long texts are rows
    like any. Columns of ``docs`` named __shard or __slot give way to the new ones; other names don't matter.
    """
    names = [c for c in docs.columns if c not in ("__shard", "__slot")]
    held = keep(docs.select(F.monotonically_increasing_id().alias("__place"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")))
    place = F.col("__place")
    held = held.select(F.shiftright(place, 33).cast("int").alias("__block"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"), "__row")
    long = [F.coalesce(F.octet_length(F.col("__row")[f.name]), F.lit(0)) for f in docs.schema if f.name in names and f.dataType.simpleString() in ("string", "binary")]
    counted = held.groupBy("__block").agg(F.count("*").alias("n"), F.sum(sum(long, F.lit(0)).cast("bigint")).alias("size")).collect()
    sizes = {r["__block"]: r.n for r in counted}
    total = sum(sizes.values())
    order = sorted(sizes)
    counts = matrix([sizes[b] for b in order], [total // shards + (j < total % shards) for j in range(shards)], np.random.default_rng(seed))
    sent = docs.sparkSession.sparkContext.broadcast({b: (sizes[b], np.cumsum(c)) for b, c in zip(order, counts, strict=True)})

    @F.pandas_udf("int")
    def deal(blocks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, rank = None, None
        for block, at in blocks:
            out = np.zeros(len(block), dtype=np.int32)
            for b in block.unique():
                n, stops = sent.value[b]
                if b != last:
                    last, rank = b, np.random.default_rng([seed, b]).permutation(n)
                own = (block == b).to_numpy()
                out[own] = np.searchsorted(stops, rank[at.to_numpy()[own]], "right")
            yield pd.Series(out)

    parts = max(1, total // shards // ORDERED_ROWS, sum(r["size"] for r in counted) // shards // ORDERED_BYTES)
    key = F.xxhash64(F.lit(seed), "__block", "__at")
    dealt = held.withColumns({"__shard": deal("__block", "__at"), "__key": key}).withColumn("__part", F.expr(f"cast(floor((__key / 18446744073709551616D + 0.5D) * {parts}) as int)"))
    before = dealt.groupBy("__shard", "__part").agg(F.count("*").alias("n"))
    before = keep(before.select("__shard", "__part", (F.sum("n").over(W.partitionBy("__shard").orderBy("__part")) - F.col("n")).alias("__before")))
    ranked = dealt.withColumn("__rank", F.row_number().over(W.partitionBy("__shard", "__part").orderBy("__key", "__block", "__at")) - 1).join(before, ["__shard", "__part"])
    return ranked.select("__shard", (F.col("__rank") + F.col("__before")).alias("__slot"), *[F.col("__row")[c].alias(c) for c in names])
