"""Approximate nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.llm.scratch import keep

#: Distinct vectors of a partition aimed at, partitions at most, and sampled vectors a partition is learned from.
PARTITION, MOST_PARTITIONS, LEARN = 1600, 128, 128
#: Neighbours of a vector in the graph, rounds of power iteration, swap rounds and passes of training.
NEIGHBOURS, POWER, SWAPS, EPOCHS = 10, 60, 8, 60
#: Groups of partitions, and vectors and queries of a group that one task compares; a query returns k rows from each group, not from each partition.
SHARDS, BLOCK, QUERIES = 8, 65_536, 1024
#: Queries by which the routed probability is chosen, and as many others by which the recall is measured.
AUDIT = 192
#: Probabilities that a query's partitions may have to sum to; the last one takes all partitions.
MASSES = (0.5, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 2.0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product of each row, itself left out."""
    out = []
    for lo in range(0, len(x), 1024):
        near = x[lo : lo + 1024] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part of each node: the graph is halved again and again (``parts`` is a power of two), each half as large as the other. A half is the
    lower side of the second eigenvector of the walk on the subgraph, found by power iteration, mended by swaps of the
    nodes with most edges to the other side."""
    part = np.zeros(len(graph), dtype=np.int64)
    rng = np.random.default_rng(1)
    at = np.repeat(np.arange(len(graph)), graph.shape[1])
    to = graph.ravel()
    at, to = np.concatenate([at, to]), np.concatenate([to, at])
    for level in range(parts.bit_length() - 1):
        inside = part[at] == part[to]
        a, b = at[inside], to[inside]
        degree = np.maximum(np.bincount(a, minlength=len(part)), 1)
        side = rng.standard_normal(len(part))
        count = np.bincount(part, weights=degree, minlength=1 << level)
        for _ in range(POWER):  # all subgraphs at once; the constant vector of each is taken out
            side = side + np.bincount(a, weights=side[b], minlength=len(part)) / degree
            side -= (np.bincount(part, weights=side * degree, minlength=1 << level) / count)[part]
            side /= np.sqrt(np.bincount(part, weights=side**2, minlength=1 << level) + 1e-300)[part]
        order = np.lexsort((side, part))
        size = np.bincount(part, minlength=1 << level)
        rank = np.empty(len(part), dtype=np.int64)
        rank[order] = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        upper = rank >= size[part] // 2
        for _ in range(SWAPS):
            other = np.bincount(a, weights=upper[a] != upper[b], minlength=len(part))
            gain = 2 * other - np.bincount(a, minlength=len(part))
            swapped = False
            for p in range(1 << level):
                mine = np.flatnonzero(part == p)
                low, high = mine[~upper[mine]], mine[upper[mine]]
                low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
                n = min(len(low), len(high), max(1, len(mine) // 20))
                go = gain[low[:n]] + gain[high[:n]] > 0
                upper[low[:n][go]], upper[high[:n][go]] = True, False
                swapped |= bool(go.any())
            if not swapped:
                break
        part = 2 * part + upper
    return part


def train(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a softmax over (x, 1) for the target distributions, by Adam on mini-batches."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros((x.shape[1], target.shape[1])), 0.0, 0.0
    rng, step = np.random.default_rng(2), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 512):
            rows = order[lo : lo + 512]
            grad = x[rows].T @ (probabilities(x[rows], w) - target[rows]) / len(rows) + 1e-5 * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors as the classifier sees them: of length sqrt(their number of components), as a direction has no extreme values, and a 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1]), np.ones((len(x), 1))])


def learn(x: np.ndarray, parts: int) -> np.ndarray:
    """The classifier's weights, from a sample of vectors: their neighbour graph is cut into balanced parts, and a row's target is half
    its own part and half those of its neighbours."""
    if parts < 2 or len(x) < 4 * parts:
        return np.zeros((x.shape[1] + 1, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        graph = neighbour_graph(x / np.abs(x).max(), min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(graph, parts)
    target = 0.5 * np.eye(parts)[part]
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 0.5 / graph.shape[1])
    return train(_scaled(x)[:, :-1], target)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components, so that equal vectors have equal ones."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best_rows(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` (its number, rows of ``x``, exact inner products) with all that may be among the k largest. A fast matrix product
    chooses, with a margin above its rounding error; sums in a fixed order decide."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(q, axis=1) * 1e-12 * max(8, x.shape[1])
        for lo in range(0, len(q), 256):
            near = np.nan_to_num(q[lo : lo + 256] @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            kth = -np.partition(-near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for i in range(len(near)):
                at = np.flatnonzero(near[i] >= kth[i] - far[lo + i]) if np.isfinite(kth[i] - far[lo + i]) else np.arange(len(x))
                yield lo + i, at, np.nan_to_num(inner_products(np.broadcast_to(q[lo + i], (len(at), q.shape[1])), x[at]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), dtype=float).reshape(rows, -1)


def _listed(own: object, keys: list[list], at: np.ndarray, score: np.ndarray, k: int) -> list[tuple]:
    """The k best (score, key) of vectors with the same inner product for every key they have; ``own`` is left out."""
    order = sorted(range(len(at)), key=lambda i: (-score[i], keys[at[i]][0]))[: k + 1]
    rows = [(score[i], key) for i in order for key in keys[at[i]] if key != own]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def _compared(groups: DataFrame, kind: str, k: int) -> DataFrame:
    """query, key, score: the k best rows of each group for each of its queries, from the partitions that it goes to."""

    def run(table: pa.Table) -> pa.Table:
        x, asked = _matrix(table.column("x"), table.num_rows), table.column("asked").to_numpy(zero_copy_only=False)
        keys, parts = table.column("keys").to_pylist(), table.column("parts").to_pylist()
        mine, rows = np.flatnonzero(asked), np.flatnonzero(~asked)
        of = np.array([parts[i][0] for i in rows], dtype=np.int64)
        goes: dict[int, list[int]] = {}
        for i in mine.tolist():
            for part in parts[i]:
                goes.setdefault(part, []).append(i)
        held: dict[int, list[tuple]] = {}
        for part, own in goes.items():
            near = rows[of == part]
            names = [keys[j] for j in near]
            if names:
                for i, at, score in best_rows(x[own], x[near], k + 1):
                    found = held.get(own[i], []) + _listed(keys[own[i]][0], names, at, score, k)
                    held[own[i]] = sorted(found, key=lambda r: (-r[0], r[1]))[:k]
        out = [(keys[i][0], key, s) for i, found in held.items() for s, key in found]
        named = table.column("keys").type.value_type
        return pa.table({"query": pa.array([r[0] for r in out], named), "key": pa.array([r[1] for r in out], named), "score": pa.array([r[2] for r in out], pa.float64())})

    return groups.groupBy("dim", "shard", "block", "chunk").applyInArrow(run, f"query {kind}, key {kind}, score double")


class Router:
    """The learned partitions: ``part`` of every vector, and the partitions to which a query goes."""

    def __init__(self, weights: np.ndarray, dim: int) -> None:
        self.weights, self.dim, self.parts = weights, dim, weights.shape[1]

    def likely(self, x: np.ndarray) -> np.ndarray:
        return probabilities(_scaled(x), self.weights)

    def routes(self, x: np.ndarray, mass: float) -> np.ndarray:
        """Whether a query goes to a partition: to the most probable ones until they sum to ``mass``."""
        p = self.likely(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        out = np.zeros(p.shape, dtype=bool)
        np.put_along_axis(out, order, before < mass, axis=1)
        return out


def _assigned(nodes: DataFrame, router: Router, mass: float | None) -> DataFrame:
    """``nodes`` (dim, x, ...) with parts: the most probable one, or those that a query goes to. Vectors of other lengths than the learned
    one are all in part 0."""
    sent = nodes.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                dims = part.column(part.schema.get_field_index("dim")).to_numpy()
                lists: list = [[0]] * part.num_rows
                mine = np.flatnonzero(dims == router.dim)
                if len(mine):
                    x = _matrix(part.column(part.schema.get_field_index("x")).take(pa.array(mine)), len(mine))
                    chosen = router.likely(x).argmax(axis=1)[:, None].tolist() if mass is None else [np.flatnonzero(r).tolist() for r in router.routes(x, mass)]
                    for i, r in zip(mine.tolist(), chosen, strict=True):
                        lists[i] = r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*part.schema.names, "parts"])

    columns = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    return nodes.mapInArrow(run, f"{columns}, parts array<int>")


def _truth(nodes: DataFrame, asked: list, dim: int, kind: str, k: int) -> DataFrame:
    """query, part: the partitions of the k nearest vectors of some queries, by brute force; each task keeps k a query."""
    sent = nodes.sparkSession.sparkContext.broadcast(([r.key for r in asked], np.array([r.x for r in asked], dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        held: list[list[tuple]] = [[] for _ in names]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                rows = batch.slice(lo, 4096)
                x, keys, part = _matrix(rows.column(0), rows.num_rows), rows.column(1).to_pylist(), rows.column(2).to_numpy()
                for i, at, score in best_rows(q, x, k + 1):
                    found = [(-s, keys[j][0], part[j]) for j, s in zip(at.tolist(), score.tolist(), strict=True) if keys[j] != [names[i]]]
                    held[i] = sorted(held[i] + found)[:k]
        rows = [(n, key, -s, int(p)) for n, h in zip(names, held, strict=True) for s, key, p in h]
        yield pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], named), "key": pa.array([r[1] for r in rows], named), "score": pa.array([r[2] for r in rows], pa.float64()), "part": pa.array([r[3] for r in rows], pa.int32())})

    named = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    own = nodes.where(F.col("dim") == dim).select("x", "keys", "part")
    found = own.mapInArrow(run, f"query {kind}, key {kind}, score double, part int")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("n", place).where(F.col("n") <= k).select("query", "part")


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, least: float = 0.95, never_under: float = 0.9) -> DataFrame:
    """query_id, rank, vec_id, score, recall: for each row for which ``queries`` (over ``key``) holds the k rows found with the largest inner product, in
    double precision, nearest first, equal ones by smaller key; the query's own key is left out.

    Partitions are learned from a bounded sample of distinct vectors (LEARN a partition, MOST_PARTITIONS of them at most); every
    vector is indexed in its most probable one. A query goes to its most probable partitions, until they sum to the least
    probability that finds the share ``least`` of the true neighbours of AUDIT queries; the share that this finds for as many
    others is ``recall`` (null where there are no others), and where it is under ``never_under`` more is taken, up to all
    partitions, which is exact. Vectors whose length is not the commonest are compared with all of their length.

    Equal vectors are indexed once, with their k + 1 smallest keys, so a crowd of copies costs no more than one vector. Rows with a
    null key, a null, empty or zero vector or one with null or non-finite components take no part; vectors of different
    lengths are no neighbours. A key that is repeated as a query is one query, with its smallest vector. A query without
    candidates, and an empty table, give no rows. Products beyond the range of a double count as infinite, undefined ones as
    least. Other columns are not read, so their names can't clash.
    """
    kind = dict(vectors.dtypes)[key]
    x = F.col("x")
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<float>" if "float" in dict(vectors.dtypes)[vector] else "array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fine = F.col("key").isNotNull() & x.isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.where(fine).withColumn("dim", F.size("x"))
    first = F.row_number().over(W.partitionBy("x").orderBy("key"))
    nodes = keep(rows.select("key", "x", "dim").distinct().withColumn("n", first).where(F.col("n") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.first("dim").alias("dim")))
    asked = keep(rows.where("asked").groupBy("key").agg(F.min("x").alias("x")).select("key", "x", F.size("x").alias("dim")))
    common = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (common["dim"], common["n"]) if common else (0, 0)
    parts = 1 << min(MOST_PARTITIONS.bit_length() - 1, max(0, round(np.log2(max(1, n / PARTITION)))))
    drawn = lambda df, salt, most, all_: df.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(salt), "x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, all_)))))
    sample = drawn(nodes, "learn", LEARN * parts, n).limit(2 * LEARN * parts).select("x").collect()
    sample = sorted(r.x for r in sample)
    router = Router(learn(np.array(sample, dtype=float), parts) if sample else np.zeros((dim + 1, 1)), dim)
    nodes = keep(_assigned(nodes, router, None).select("x", "keys", "dim", F.col("parts")[0].alias("part")))
    mass, recall = _calibrated(nodes, drawn(asked, "audit", 2 * AUDIT, asked.count()), router, kind, k, least, never_under)
    shard = lambda c: F.pmod(c, F.lit(SHARDS))
    routed = _assigned(asked, router, mass).select(F.array("key").alias("keys"), "x", "dim", "parts", F.explode(F.array_distinct(F.transform("parts", shard))).alias("shard"))
    routed = routed.withColumn("parts", F.filter("parts", lambda p: shard(p) == F.col("shard")))
    nodes = nodes.select("keys", "x", "dim", F.array("part").alias("parts"), shard(F.col("part")).alias("shard"))
    size = lambda df, most, name: df.groupBy("dim", "shard").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = F.broadcast(size(nodes, BLOCK, "blocks").join(size(routed, QUERIES, "chunks"), ["dim", "shard"]))  # SHARDS rows a length of vectors
    spread = lambda df, salt, own, other, asked: df.join(sizes, ["dim", "shard"]).select("dim", "shard", "keys", "x", "parts", F.pmod(F.xxhash64(F.lit(salt), "keys"), F.col(own + "s")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)).alias(other), F.lit(asked).alias("asked"))
    groups = spread(nodes, "block", "block", "chunk", False).unionByName(spread(routed, "chunk", "chunk", "block", True))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    found = _compared(groups, kind, k).withColumn("rank", place).where(F.col("rank") <= k)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score", F.lit(recall).cast("double").alias("recall"))


def _calibrated(nodes: DataFrame, drawn: DataFrame, router: Router, kind: str, k: int, least: float, never_under: float) -> tuple[float, float | None]:
    """(probability that a query's partitions sum to, recall measured): one half of the audited queries chooses, the other measures."""
    asked = sorted(drawn.limit(4 * AUDIT).select("key", "x").collect(), key=lambda r: r.key)
    if router.parts == 1 or not asked:
        return MASSES[-1], 1.0 if asked else None
    place = {r.key: i for i, r in enumerate(asked)}
    truth = np.zeros((len(asked), router.parts))
    for r in _truth(nodes, asked, router.dim, kind, k).collect():  # k rows an audited query
        truth[place[r["query"]], r["part"]] += 1
    truth /= np.maximum(truth.sum(axis=1, keepdims=True), 1)
    x = np.array([r.x for r in asked], dtype=float)
    shares = [(mass, (truth * router.routes(x, mass)).sum(axis=1)) for mass in MASSES]
    mass, share = next((m, s) for m, s in shares if s[::2].mean() >= least or m == MASSES[-1])
    if len(asked) > 1 and share[1::2].mean() < never_under:
        mass, share = next((m, s) for m, s in shares if (s.mean() >= least and s[1::2].mean() >= never_under) or m == MASSES[-1])
    return mass, float(share[1::2].mean()) if len(asked) > 1 else None
