"""Benchmark passages in documents: one Aho-Corasick automaton over the items' normalised windows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.scratch import keep

#: Nodes of the automaton that one scan of the documents takes, in each Python worker: about 45 bytes each. More item
#: words are split over several automata, used one after the other.
AUTOMATON_NODES = 8_000_000

_built: dict[int, tuple[ahocorasick.Automaton, list[list[str]], dict[bytes, int]]] = {}
_numbers = itertools.count()


def words_of(raw: bytes) -> list[bytes]:
    """Words (ASCII letters in lower case, digits, all that is not ASCII)."""
    return raw.translate(tx.WORDS_TABLE).split()


def normalise(raw: bytes) -> tuple[str, int]:
    """The words of ``words_of`` between single blanks, a byte a character, and their number."""
    words = words_of(raw)
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


class Passages:
    """Windows of some items, sent to the executors; each Python worker builds the automaton once. Its symbols are the
    numbers of the items' words, so that a window has a node a word, and places found are places of words."""

    def __init__(self, items: list[tuple[list[str], bytes]], width: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[str]] = {}
        for names, raw in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(raw))
            for i in range(max(1, len(words) - width + 1) if words else 0):
                self.owners.setdefault(words[i : i + width], set()).update(names)
        self.number = hash((next(_numbers), id(self)))

    def automaton(self) -> tuple[ahocorasick.Automaton, list, dict[bytes, int]]:
        if self.number not in _built:
            _built.clear()
            found, lists = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
            for window, items in self.owners.items():
                found.add_word(window, (len(window), len(lists)))
                lists.append(sorted(items))
            if lists:
                found.make_automaton()
            _built[self.number] = found, lists, self.numbers
        return _built[self.number]

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, disjoint word intervals that windows cover, items found) of one text."""
        found, lists, numbers = self.automaton()
        words = words_of(raw)
        if not lists or not words:
            return len(words), [], set()
        hits = list(found.iter(tuple(map(numbers.get, words, itertools.repeat(0)))))
        return len(words), merged([(end + 1 - n, end + 1) for end, (n, _) in hits]), {x for i in {i for _, (_, i) in hits} for x in lists[i]}


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _passages(benchmark: DataFrame, item: str, text: str, width: int) -> Iterator[tuple[object, bool]]:
    """(broadcast of ``Passages``, whether it is the last): one where the items' words make at most AUTOMATON_NODES, else several of about that size.
    Equal texts are one item of several names; a part is collected, sent, and given up when the next one is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    words = F.size(F.expr(r"regexp_extract_all(decode(raw, 'utf-8'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)"))
    items = keep(items.groupBy("raw").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("words", words).where("words > 0"))
    nodes = items.agg(F.sum(F.col("words") * F.least("words", F.lit(width)))).first()[0] or 0
    parts = max(1, -(-int(nodes) // AUTOMATON_NODES))
    for i in range(parts):
        sent = spark.sparkContext.broadcast(Passages([(r["items"], bytes(r.raw)) for r in items.where(F.pmod(F.xxhash64("raw"), F.lit(parts)) == i).select("items", "raw").collect()], width))
        yield sent, i == parts - 1
        if i < parts - 1:
            sent.unpersist()


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """``key``, n_words, n_hit, items (sorted strings), spans (byte offsets in the original text) per row of ``docs``.

    A window is ``width`` consecutive words of an item, or all words of a shorter one; a document word in any place
    where a window stands is hit. Texts are scanned once, whole. Null and empty texts have no words; a null item_id
    counts as the empty string; repeated items count once, repeated rows are rows of their own. Only the named
    columns are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    held = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"), F.lit(None).cast("array<bigint>").alias("hit"), F.lit(None).cast("array<string>").alias("items"))

    def scan(passages, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, hits, found, places = [], [], [], []
                for raw, old, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    n, new, more = passages.value.scan(raw)
                    both = merged([*zip((old or [])[::2], (old or [])[1::2], strict=True), *new])
                    words.append(n)
                    hits.append([x for pair in both for x in pair])
                    found.append(sorted(more.union(items or [])))
                    if last and both:
                        data = np.frombuffer(raw, np.uint8)
                        start, end, _ = tx.spans(data, np.array([0, len(data)]), tx.ALNUM)
                        places.append([{"start": int(start[a]), "stop": int(end[b - 1])} for a, b in both])
                    else:
                        places.append([])
                hit, names = pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))
                if last:
                    covered = pa.array([sum(x[1::2]) - sum(x[::2]) for x in hits], pa.int64())
                    spans = pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), covered, names, spans], names=["key", "n_words", "n_hit", "items", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hit, names], names=["key", "raw", "hit", "items"])

        return run

    for passages, last in _passages(benchmark, item, item_text, width):
        if not last:
            held = keep(held.mapInArrow(scan(passages, False), f"key {kind}, raw binary, hit array<bigint>, items array<string>"))
    out = held.mapInArrow(scan(passages, True), f"key {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, stop: bigint>>")
    return out.withColumnRenamed("key", key) if key != "key" else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no window of an item."""
    at = docs.columns.index(text)
    for passages, last in _passages(benchmark, item, item_text, width):

        def run(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not passages.value.scan((t or "").encode())[1] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = keep(docs)
    return docs
