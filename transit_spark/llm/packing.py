"""Packing of token sequences into windows by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transit_spark.llm import text as tx
from transit_spark.llm.scratch import keep

#: Pieces of one length that are numbered in one task.
RANKED_ROWS = 20_000


@cache
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks are in ``vocabulary``; ids of texts without an added token are those of the tokenizers file of the same vocabulary, in a quarter of the time."""
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokenizers_file(vocabulary: str) -> str:
    return public_tokenizers.path(vocabulary.removesuffix(".tiktoken") + ".json")


@cache
def added_tokens(vocabulary: str) -> tuple[str, ...]:
    """The added tokens of the tokenizers file, which it matches in texts before it splits them."""
    with open(_tokenizers_file(vocabulary), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@cache
def whole_tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(_tokenizers_file(vocabulary))


def encode(text: str, vocabulary: str) -> list[int]:
    """The ids of the tokenizers file, which itself takes the texts that hold an added token."""
    if any(token in text for token in added_tokens(vocabulary)):
        return whole_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    return encoder(vocabulary).encode_ordinary(text)


def pieces(docs: DataFrame, key: str, text: str, capacity: int, vocabulary: str, end_id: int, ids: bool) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids: little-endian 32-bit): each document's ids and ``end_id``, cut into pieces of ``capacity``, the last shorter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, 1, 1 << 20):
                row, start, length, crc, total, raw = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.array([*encode(text or "", vocabulary), end_id], dtype="<u4")
                    for at in range(0, len(tokens), capacity):
                        cut = tokens[at : at + capacity].tobytes()
                        row.append(i)
                        start.append(at)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(len(tokens))
                        if ids:
                            raw.append(cut)
                out = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), *([pa.array(raw, pa.binary())] if ids else [])]
                yield pa.RecordBatch.from_arrays(out, names=["key", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * ids)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int] | None:
    """The multiset of lengths with the greatest sum up to ``capacity`` among those with the longest one left: {length: uses}.

    A bitset holds the sums that the lengths so far can make with their counts; the bitsets kept for each length let
    the counts be traced back from the best sum.
    """
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    if not lengths:
        return None
    used = {lengths[0]: 1}
    room = capacity - lengths[0]
    mask, sums, kept = (1 << room + 1) - 1, 1, []
    for x in lengths:
        kept.append((x, sums))
        for _ in range(min(counts[x] - (x == lengths[0]), room // x)):
            more = sums | (sums << x) & mask
            if more == sums:
                break
            sums = more
        if sums >> room & 1:
            break
    left = sums.bit_length() - 1
    if not sums >> left & 1:
        return used
    for x, before in reversed([*kept]):
        while not before >> left & 1:
            left -= x
            used[x] = used.get(x, 0) + 1
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(windows, {length: uses in each}): every window's multiset by ``fill``, used as often as the lengths last."""
    counts, out = dict(histogram), []
    while used := fill(counts, capacity):
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= times * n
        out.append((times, used))
    return out


def slots(made: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of pieces of one length, sorted: the pieces ranked from ``rank`` on go ``uses`` to a window from ``window`` on, at ``offset``."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for times, used in made:
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            rows.append((x, ranks.get(x, 0), n, base, offset))
            ranks[x] = ranks.get(x, 0) + times * n
            offset += x * n
        base += times
    rows.sort()
    return dict(zip(("length", "rank", "uses", "window", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, ids: bool = False) -> DataFrame:
    """``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) per piece.

    Every row's ids, then ``end_id``, are cut at multiples of ``capacity``. Sequences are filled by minimum bin slack
    over the histogram of piece lengths, which has at most ``capacity`` entries however many rows there are; pieces of
    one length are numbered in parallel and take the places of the plan in that order. sequence_id and each sequence's
    offsets are gapless from 0. A null text is empty and is a piece of one id; repeated rows are packed each; an empty
    table gives no rows. Only the named columns are read.
    """
    cut = keep(pieces(docs, key, text, capacity, vocabulary, end_id, ids))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    salts = max(1, sum(histogram.values()) // RANKED_ROWS)
    salted = cut.withColumn("salt", F.expr(f"pmod(xxhash64(key, start, ids_crc32), {salts})"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("key", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        order = (t["length"] << 44) + t["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, batch.num_columns - 1))
            i = np.searchsorted(order, (length << 44) + rank, "right") - 1
            own = rank - t["rank"][i]
            window, offset = t["window"][i] + own // t["uses"][i], t["offset"][i] + own % t["uses"][i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(window), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    out = ranked.select(*names, F.col("rank").cast("bigint")).mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key) if key != "key" else out
