"""Rows with wanted keys, found before anything is shuffled by a filter of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the filter's bits: 8 MB at most, however many keys are wanted.
FILTER_BITS = 26


class Wanted:
    """A filter that lets rows with the keys ``name`` of ``wanted`` pass, and a few others, whose hash is that of a wanted key.

    It has one hashed bit for each wanted key, ``each`` bits or more a key while FILTER_BITS allow; with more keys more other
    rows pass, so that a join or semi join must follow. It spares those rows their shuffle.
    """

    def __init__(self, wanted: DataFrame, name: str, each: int = 16) -> None:
        self.bits = min(FILTER_BITS, max(15, (each * wanted.count()).bit_length()))
        at = wanted.select(self.place(name).alias("at"))
        maps = at.groupBy(F.shiftright("at", 15).alias("i")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(1 << 15))).alias("m"))
        held = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in maps.collect():  # 4096 bytes each
            held[r.i * 4096 : r.i * 4096 + 4096] = np.frombuffer(r.m, np.uint8)
        self.sent = wanted.sparkSession.sparkContext.broadcast(held)

    def place(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << self.bits))


def passes(sent: Broadcast, at: pa.Array) -> pa.Array:
    """For ``Wanted.place`` of some rows, whether they pass; for use in tasks."""
    at = at.to_numpy()
    return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame, name: str, each: int = 16) -> DataFrame:
    """The rows that pass ``Wanted``, all columns as they are."""
    filter_ = Wanted(wanted, name, each)
    sent = filter_.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(passes(sent, batch.column(batch.num_columns - 1))).select(range(batch.num_columns - 1))

    return rows.select("*", filter_.place(key).alias("__place")).mapInArrow(run, rows.schema)
