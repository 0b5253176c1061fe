"""Ranked lexical search by dual trees over items and documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.llm.scratch import keep
from transit_spark.llm.text import _BYTE, ALNUM, LOWER, _powers, mix, pieces, raw, spans
from transit_spark.llm.wanted import Wanted, passes

#: Bytes of text that are counted at once; documents, their terms, and items of a group that one task takes.
TEXT, DOCS, TERMS, ITEMS = 1 << 20, 2048, 1 << 21, 512
#: Documents and items of a leaf, leaves of an upper node, and terms whose maxima are compared at once.
LEAF, ITEM_LEAF, FAN, COLUMNS = 32, 8, 8, 8192
#: One document in so many is ranked first, for scores below which no other document is wanted.
SEED = 32


def _hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word and how many words each row has."""
    data = LOWER[data]
    start, end, n = spans(data, at, ALNUM)
    up, down = _powers.upto(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start]), n


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about TEXT bytes that end between words."""
    while len(data):
        stop = min(len(data), TEXT)
        if stop < len(data):
            gap = np.flatnonzero(~ALNUM[data[:stop]])
            if len(gap):
                stop = int(gap[-1]) + 1
            else:  # one word is longer: the part ends with it
                after = next((lo + int(g[0]) for lo in range(stop, len(data), TEXT) if len(g := np.flatnonzero(~ALNUM[data[lo : lo + TEXT]]))), len(data))
                stop = after
        yield data[:stop]
        data = data[stop:]


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times) of each row's distinct words, how many distinct words each row has, and all its words."""
    data, at = raw(column)
    if len(at) == 2 and len(data) > TEXT:
        found = [np.unique(_hashes(p, np.array([0, len(p)]))[0], return_counts=True) for p in _parts(data)]
        h, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([f[1] for f in found]), minlength=len(h)).astype(np.int64)
        return h, times, np.array([len(h)]), np.array([times.sum()])
    h, n = _hashes(data, at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.bincount(row[first], minlength=len(n)), n


class _Terms(Wanted):
    """A filter of wanted terms by the upper bits of their hashes."""

    def place(self, key: str) -> Column:
        return F.shiftrightunsigned(F.col(key), 64 - self.bits)


def _sparse(rows: DataFrame, filter_: Wanted | None = None) -> DataFrame:
    """key, n (words), terms, times of ``rows`` (key, text); with a filter only terms that pass, which all wanted ones do."""
    sent, bits = (filter_.sent, filter_.bits) if filter_ else (None, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, TEXT):
                h, times, size, n = _counted(part.column(1))
                if sent is not None:
                    ok = passes(sent, pa.array((h >> np.uint64(64 - bits)).astype(np.int64))).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(size)), size)[ok]
                    h, times, size = h[ok], times[ok], np.bincount(row, minlength=len(size))
                stop = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(stop, pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64))) for v in (h, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], names=["key", "n", "terms", "times"])

    kind = dict(rows.dtypes)["key"]
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, n bigint, terms array<bigint>, times array<bigint>")


def _chain(x: np.ndarray) -> np.ndarray:
    """An order of items in which each is followed by the one left that is most like it."""
    norm = np.maximum(np.linalg.norm(x, axis=1), 1)
    like = (x @ x.T) / norm[:, None] / norm[None, :]
    left, order = np.ones(len(x), dtype=bool), []
    at = 0
    for _ in range(len(x)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, like[at], -1).argmax())
    return np.array(order, dtype=np.int64)


def _maxima(group: np.ndarray, column: np.ndarray, value: np.ndarray, groups: int, columns: int) -> np.ndarray:
    """The greatest value of each column in each group, 0 where it has none."""
    out = np.zeros((groups, columns))
    np.maximum.at(out, (group, column), value)
    return out


def _folded(x: np.ndarray, by: int) -> np.ndarray:
    return np.maximum.reduceat(x, np.arange(0, len(x), by), axis=0) if len(x) else x


class DualTree:
    """A hierarchy of items over weights and one of documents over impacts: every node holds the greatest coordinate of what is below it,
    so that the product of two nodes bounds every score of an item and a document below them."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, docs: int) -> None:
        vocabulary = np.unique(np.concatenate([t for t, _ in items]))
        place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        ok = vocabulary[place] == terms
        self.rows, self.columns, self.impacts, self.docs, self.width = rows[ok], place[ok], impacts[ok].astype(float), docs, len(vocabulary)
        self.items = np.zeros((len(items), self.width))
        for i, (t, w) in enumerate(items):
            self.items[i, np.searchsorted(vocabulary, t)] = w
        self.item_order = _chain(self.items)
        self.leaves = _folded(self.items[self.item_order], ITEM_LEAF)
        self.upper = _folded(self.leaves, FAN)
        # Documents that the same items may like come together, and within them short ones, whose impacts are greater.
        near = np.zeros((docs, len(self.leaves)))
        for lo in range(0, len(self.rows), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            np.add.at(near, self.rows[s], self.impacts[s, None] * self.leaves[:, self.columns[s]].T)
        top = np.zeros(docs)
        np.maximum.at(top, self.rows, self.impacts)
        order = np.lexsort((-top, near.argmax(axis=1)))
        self.doc_order = order
        rank = np.empty(docs, dtype=np.int64)
        rank[order] = np.arange(docs)
        by = np.argsort(rank[self.rows], kind="stable")
        self.rows, self.columns, self.impacts = rank[self.rows][by], self.columns[by], self.impacts[by]
        self.doc_leaves = -(-docs // LEAF)

    def _bounds(self, items: np.ndarray, fold: int) -> np.ndarray:
        """Products of item nodes with nodes of ``fold`` document leaves, a slice of the terms at a time."""
        total = np.zeros((len(items), -(-self.doc_leaves // fold)))
        for lo in range(0, self.width, COLUMNS):
            own = (self.columns >= lo) & (self.columns < lo + COLUMNS)
            width = min(COLUMNS, self.width - lo)
            total += items[:, lo : lo + width] @ _maxima(self.rows[own] // (LEAF * fold), self.columns[own] - lo, self.impacts[own], total.shape[1], width).T
        return total

    def search(self, floors: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) by item, the k best that reach its floor, of equal scores those with the smaller ``tie`` (-1, 0: no more). A pair of nodes is
        left where its bound is below the weakest kth score of its items; what remains goes one level down, on both sides. ``opened``
        counts the pairs of an item and a document leaf that are scored."""
        self.opened = 0
        m = len(self.items)
        order = self.item_order
        floors = floors[order].astype(float)
        best, who = np.zeros((m, k)), np.full((m, k), -1)
        weakest = lambda by: np.minimum.reduceat(floors, np.arange(0, m, by))
        bound = self._bounds(self.upper, FAN)
        alive = (bound >= weakest(ITEM_LEAF * FAN)[:, None]) & (bound > 0)
        alive = np.repeat(np.repeat(alive, FAN, axis=0)[: len(self.leaves)], FAN, axis=1)[:, : self.doc_leaves]
        bound = self._bounds(self.leaves, 1)
        alive &= (bound >= weakest(ITEM_LEAF)[:, None]) & (bound > 0)
        alive = np.repeat(alive, ITEM_LEAF, axis=0)[:m]
        bound = self._bounds(self.items[order], 1)
        alive &= (bound >= floors[:, None]) & (bound > 0)
        stop = np.searchsorted(self.rows, np.arange(0, (self.doc_leaves + 1) * LEAF, LEAF))
        for leaf in np.argsort(-np.where(alive, bound, 0).max(axis=0, initial=0), kind="stable"):
            kth = np.maximum(best[:, -1], floors)
            mine = np.flatnonzero(alive[:, leaf] & (bound[:, leaf] >= kth))
            if not len(mine):
                continue
            self.opened += len(mine)
            s = slice(stop[leaf], stop[leaf + 1])
            used, at = np.unique(self.columns[s], return_inverse=True)
            size = min(LEAF, self.docs - leaf * LEAF)
            dense = np.zeros((size, len(used)))
            dense[self.rows[s] - leaf * LEAF, at] = self.impacts[s]
            score = self.items[order[mine]][:, used] @ dense.T
            docs = np.broadcast_to(self.doc_order[leaf * LEAF : leaf * LEAF + size], score.shape)
            score = np.where((score > 0) & (score >= floors[mine][:, None]), score, 0)
            both, ids = np.hstack([best[mine], score]), np.hstack([who[mine], np.where(score > 0, docs, -1)])
            top = np.lexsort((np.where(ids >= 0, tie[ids], len(tie)), -both), axis=1)[:, :k]
            best[mine], who[mine] = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
        back = np.empty(m, dtype=np.int64)
        back[order] = np.arange(m)
        return who[back], best[back]


def _ranked(docs: DataFrame, items: DataFrame, chunks: int, shards: int, k: int, kind: str) -> DataFrame:
    """item, key, score: the k best documents of each group for each of its items. ``docs``: key, name, terms, impacts; ``items``: item, terms,
    weights, floor."""

    def run(table: pa.Table) -> pa.Table:
        item, is_doc = table.column("item").to_numpy(), table.column("is_doc").to_numpy(zero_copy_only=False)
        mine, rows = table.filter(pa.array(~is_doc)), table.filter(pa.array(is_doc))
        if not mine.num_rows or not rows.num_rows:
            return pa.table({"item": pa.array([], pa.int64()), "key": rows.column("key").slice(0, 0), "score": pa.array([], pa.int64())})
        own = [(np.array(t, dtype=np.int64), np.array(w, dtype=np.int64)) for t, w in zip(mine.column("terms").to_pylist(), mine.column("values").to_pylist(), strict=True)]
        own = [(t[o := np.argsort(t)], w[o]) for t, w in own]
        terms, values = rows.column("terms").combine_chunks(), rows.column("values").combine_chunks()
        at = np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy()))
        tree = DualTree(own, at, terms.flatten().to_numpy(), values.flatten().to_numpy(), rows.num_rows)
        keys = rows.column("key").to_pylist()
        tie = np.empty(len(keys), dtype=np.int64)
        tie[sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))] = np.arange(len(keys))
        who, score = tree.search(mine.column("floor").to_numpy(), tie, k)
        q, place = np.nonzero(who >= 0)
        names = item[~is_doc]
        return pa.table({"item": pa.array(names[q]), "key": rows.column("key").take(pa.array(who[q, place])), "score": pa.array(score[q, place].astype(np.int64))})

    none = lambda t: F.lit(None).cast(t)
    left = docs.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod("name", F.lit(shards)).cast("int").alias("shard"), F.lit(True).alias("is_doc"), F.lit(0).cast("bigint").alias("item"), "key", "terms", F.col("impacts").alias("values"), F.lit(0).cast("bigint").alias("floor"))
    right = items.select(F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(False).alias("is_doc"), "item", none(kind).alias("key"), "terms", F.col("weights").alias("values"), "floor")
    found = left.unionByName(right).groupBy("chunk", "shard").applyInArrow(run, f"item bigint, key {kind}, score bigint")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """``item``, rank, ``key``, score: for each item the k documents with the highest scores above 0, equal ones by ascending key (null last).

    Words are maximal runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased. A word that df of N documents with a word have weighs
    floor(1000 ln((2N + 2) / (2 df + 1))); a document of n words that has it tf times adds that times
    10**9 tf div (1000 tf + 8 m), m being 10 + 90 n N div L and L all words; each word of an item counts once. Words are held equal
    when their 64-bit hashes are. Sums are exact: a product is below 2**35, so 2**18 words of an item stay within a double.

    A null or empty text has no words and never scores. Repeated documents are ranked each; rows with the same item key, null being one,
    are one item with the words of all. Texts of any length are counted in parts. An item without words, and empty tables, give no rows. Other
    columns are not read, so their names can't clash.

    Only words that may be an item's stay with a document: a filter of 8 MB at most passes them. Documents are dealt by hash into groups of
    bounded size, each with a tree of its own, and items in chunks; one in SEED documents is ranked first, and its kth scores
    are floors for the rest, which is exact as they are scores of real documents.
    """
    kind, named = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    asked = keep(_sparse(items.select(F.col(f"`{item}`").alias("key"), F.col(f"`{item_text}`").alias("text"))).select(F.col("key").alias("label"), F.explode("terms").alias("term")).distinct())
    filter_ = _Terms(asked.select("term").distinct(), "term")
    held = keep(_sparse(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), filter_))
    size = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    if not size["words"]:
        return docs.sparkSession.createDataFrame([], f"`{item}` {named}, rank int, `{key}` {kind}, score bigint")
    total, words = F.lit(size["docs"]).cast("bigint"), size["words"]
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * total + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = asked.join(df, "term").select("label", "term", weight.alias("w")).where("w > 0")
    heavy = keep(weighed.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("l")).select("label", F.monotonically_increasing_id().alias("item"), F.col("l.term").alias("terms"), F.col("l.w").alias("weights")))
    m = F.expr(f"10 + (90 * n * {size['docs']}) div {words}")
    impact = F.expr("transform(times, t -> (1000000000 * t) div (1000 * t + 8 * m))")
    rows = held.where(F.size("terms") > 0).withColumn("m", m).select("key", F.xxhash64("key", "terms", "times").alias("name"), "terms", impact.alias("impacts"))
    chunks = -(-heavy.count() // ITEMS) or 1
    shards = lambda share: max(1, -(-size["docs"] // (DOCS * share)), -(-size["terms"] // (TERMS * share)))
    own = F.pmod(F.xxhash64(F.lit("seed"), "name"), F.lit(SEED))
    first = _ranked(rows.where(own == 0), heavy.withColumn("floor", F.lit(0).cast("bigint")), chunks, shards(SEED), k, kind)
    floors = first.where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    heavy = keep(heavy.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0))))
    found = _ranked(rows, heavy, chunks, shards(1), k, kind).join(heavy.select("item", "label"), "item")
    return found.select(F.col("label").alias(item), "rank", F.col("key").alias(key), "score")
