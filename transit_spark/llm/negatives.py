"""Hard-negative mining by Fagin's threshold algorithm over blocks of candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.llm.scratch import keep

#: Anchors and candidates of a group, numbers in a group's candidates, and groups aimed at so that all executors have work.
ANCHORS, LEAST, CELLS, GROUPS = 8192, 1024, 1 << 22, 48
#: Rows of each sorted list that the first round of sorted access reads; every later round goes twice as deep.
FIRST = 32
#: Integers up to here are exact in double precision.
EXACT = 1 << 53


class Lists:
    """A block of candidates with one list for each dimension, sorted by the candidates' components."""

    def __init__(self, x: np.ndarray, keys: np.ndarray) -> None:
        self.x, self.keys = x, keys
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.value = np.take_along_axis(x, self.order.T, axis=0).T

    def best(self, a: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) of anchor ``a`` its k best allowed (candidate, score): higher scores first, then smaller keys.

        Sorted access goes down the list of a dimension where the anchor's component is positive and up where it is negative.
        Every candidate that it meets is scored by random access. The threshold is the score of a candidate with the last
        components read in every list: none that was not met can be above it. The scan ends when it is strictly below the kth score of
        every window, or below the window itself; at equality a candidate not met could still have the smaller key.
        """
        m = len(self.x)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen = np.zeros(m, dtype=bool)
        at, score = np.zeros(0, dtype=np.int64), self.x[:0, 0]
        depth, found = 0, [(at, score)] * len(windows)
        lowest = min((lo for lo, _ in windows), default=np.inf)
        while depth < m and windows:
            deeper, before = min(m, max(FIRST, 2 * depth)), seen.copy()
            seen[self.order[up, m - deeper : m - depth]] = True
            seen[self.order[down, depth:deeper]] = True
            if not len(up) and not len(down):  # an anchor of zeros: every score is 0
                seen[:], deeper = True, m
            new = np.flatnonzero(seen & ~before & allowed)
            s = _held(self.x[new] @ a)
            new, s = new[s >= lowest], s[s >= lowest]
            at, score = np.concatenate([at, new]), np.concatenate([score, s])
            found = [self._top(at, score, lo, hi, k) for lo, hi in windows]
            threshold = self.value[up, m - deeper] @ a[up] + self.value[down, deeper - 1] @ a[down]
            if all(threshold < (f[1][-1] if len(f[0]) == k else lo) for f, (lo, _) in zip(found, windows, strict=True)):
                break
            at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
            score, depth = np.concatenate([f[1] for f in found])[first], deeper
        return found

    def _top(self, at: np.ndarray, score: np.ndarray, lo: float, hi: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        ok = np.flatnonzero((score >= lo) & (score <= hi))
        ok = ok[np.argsort(self.keys[at[ok]], kind="stable")]
        ok = ok[np.argsort(-score[ok], kind="stable")][:k]
        return at[ok], score[ok]


def _held(score: np.ndarray) -> np.ndarray:
    """Scores that may pass 64 bits, as the nearest that don't."""
    if not isinstance(score, np.ndarray) or score.dtype != object:
        return score
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in score] + [None], dtype=object)[:-1]


def _integers(table: pa.Table) -> np.ndarray:
    """floor(256 x) of every vector: doubles while all scores are exact in them, else Python's integers."""
    x = np.floor(256 * np.array(table.column("x").combine_chunks().flatten(), dtype=float).reshape(table.num_rows, -1))
    return x if float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < EXACT else np.vectorize(int, otypes=[object])(x)


def _names(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


def _search(pairs: DataFrame, kind: str, label: str, same: bool, k: int, share: int) -> DataFrame:
    """anchor, pos, positive, bound, key, score: the k best candidates of a group for each of its anchors (same label) or, for each of the
    anchor's positives, those of other labels whose score lies between ``share`` percent of the positive's and that."""

    def run(table: pa.Table) -> pa.Table:
        x, keys, names, mine = _integers(table), _names(table.column("key")), table.column("label").to_pylist(), table.column("asked").to_numpy(zero_copy_only=False)
        numbers = {v: i for i, v in enumerate(dict.fromkeys(names))}
        labels = np.array([numbers[v] for v in names])
        found = table.column("found").to_pylist()
        out: dict[str, list] = {"at": [], "pos": [], "positive": [], "bound": [], "key": [], "score": []}
        rows = np.flatnonzero(~mine)
        lists = {None: Lists(x[rows], keys[rows])} if not same else {}
        for i in np.flatnonzero(mine):
            own = labels[i] if same else None
            if own not in lists:
                part = rows[labels[rows] == own]
                lists[own] = Lists(x[part], keys[part])
            block = lists[own]
            allowed = block.keys != keys[i]
            if same:
                windows, who = [(-np.inf, np.inf)], [(0, None, None)]
            else:
                allowed &= labels[rows] != labels[i]
                windows, who = [(-(-share * f["score"] // 100), f["score"]) for f in found[i]], [(f["pos"], f["key"], f["score"]) for f in found[i]]
            for (at, score), (pos, positive, bound) in zip(block.best(x[i], allowed, windows, k), who, strict=True):
                out["at"] += [i] * len(at)
                out["pos"] += [pos] * len(at)
                out["positive"] += [positive] * len(at)
                out["bound"] += [bound] * len(at)
                out["key"] += block.keys[at].tolist()
                out["score"] += score.tolist()
        named = table.column("key").type
        at = np.array(out["at"], dtype=np.int64)
        return pa.table({"anchor": pa.array(keys[at].tolist(), named), "label": table.column("label").take(pa.array(at)), "x": table.column("x").take(pa.array(at)), "pos": pa.array(out["pos"], pa.int32()),
                         "positive": pa.array(out["positive"], named), "bound": pa.array(out["bound"], pa.int64()), "key": pa.array(out["key"], named), "score": pa.array(map(int, out["score"]), pa.int64())})

    vector = dict(pairs.dtypes)["x"]
    return pairs.groupBy("dim", "chunk", "shard").applyInArrow(run, f"anchor {kind}, label {label}, x {vector}, pos int, positive {kind}, bound bigint, key {kind}, score bigint")


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which ``anchors`` (over ``key``) holds, and
    each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is at least
    ``share`` percent of the positive's and not above it. Higher scores come first, of equal ones the smaller key.

    A component x counts as floor(256 x) and a score is the integer inner product. Vectors of different lengths have no
    score. Rows with a null key, label or vector, an empty one or one with null or non-finite components take no part; of rows with
    the same key the one with the smallest label, then vector, does. A score beyond 64 bits counts as the nearest
    number within them. Equal vectors are candidates each. An anchor without positives or negatives, and an empty table, give
    no rows. Other columns are not read, so their names can't clash.

    Candidates are dealt by hash into groups of bounded size, each with sorted lists of its own, and every anchor is
    sent to every group: a stated query set against all rows, in blocks. A group returns the k best, and no row is left out.
    """
    kind, name = dict(vectors.dtypes)[key], dict(vectors.dtypes)[label]
    x = F.col("x")
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<float>" if "float" in dict(vectors.dtypes)[vector] else "array<double>").alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fine = F.col("key").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    one = rows.where(fine).groupBy("key").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("key", "r.*", F.size("r.x").alias("dim"))
    rows = keep(one)
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("dim").alias("dim")).first()
    most = max(LEAST, CELLS // (size["dim"] or 1))
    shards = -(-size["n"] // min(most, max(LEAST, size["n"] // GROUPS))) or 1
    chunks = -(-size["anchors"] // min(ANCHORS, most)) or 1
    none = f"array<struct<pos:int,key:{kind},score:bigint>>"
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(n)).cast("int")
    blocks = rows.select("dim", "key", "label", "x", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), dealt(shards, "shard").alias("shard"), F.lit(False).alias("asked"), F.lit(None).cast(none).alias("found"))
    sent = lambda asked: asked.select("dim", "key", "label", "x", dealt(chunks, "chunk").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), "found")
    best = lambda df, by, k: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    asked = rows.where("anchor").withColumn("found", F.lit(None).cast(none))
    near = best(_search(blocks.unionByName(sent(asked)), kind, name, True, positives, share), ["anchor"], positives)
    # An anchor's positives are a list of ``positives`` at most.
    given = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("pos"), "key", "score")).alias("found"), F.first("label").alias("label"), F.first("x").alias("x")).select(F.col("anchor").alias("key"), "label", "x", F.size("x").alias("dim"), "found")
    hard = best(_search(blocks.unionByName(sent(keep(given))), kind, name, False, negatives, share), ["anchor", "pos"], negatives)
    return hard.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("key").alias("negative_id"), F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))
