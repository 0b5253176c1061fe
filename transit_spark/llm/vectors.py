"""Near-duplicate embeddings by robust-pruned flat graphs on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.components import components
from transit_spark.llm.scratch import keep

#: Vectors of a cluster, of a group that one task takes, and from which centroids are learned; vectors whose links the audit counts.
CLUSTER, GROUP, SAMPLE, AUDIT = 1000, 2000, 20_000, 200
MOST_CLUSTERS = 4096
#: Vectors of one length from which that length has clusters of its own; fewer are one cluster, each two blocks of which meet.
MANY = 4000
#: Audited nodes with links from which a recall is believed, and draws, each four times the one before, to find them.
AUDIT_LINKED, DRAWS = 50, 4
#: Rows of one vector from which it is dealt to several tasks, and how many.
HOT, SALTS = 10_000, 64
#: Neighbours of a node, candidates for them, the pruning factor, and nodes a greedy search holds.
DEGREE, CANDIDATES, ALPHA, BEAM = 16, 48, 1.2, 24
#: How far below the limit a node may be for the search to go on through it.
SLACK = 0.08


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a cluster that loses its rows keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def pruned(x: np.ndarray, limit: float) -> np.ndarray:
    """Robust-pruned neighbours (-1: none) of each row: of the nearest candidates the nearest is taken, and those to
    which it is nearer by ALPHA than the row itself are dropped, again and again. The nearest rows of a dense family
    are all of that family; a row with more rows within ``limit`` than places is therefore joined to as many further
    ones of them, spread evenly over their ranks, so that families within the limit of each other are joined by many edges."""
    m = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    c = min(CANDIDATES, m - 1)
    if c < 1:
        return np.full((m, 1), -1)
    cand = np.argpartition(-near, c - 1, axis=1)[:, :c]
    rows = np.arange(m)
    far = 1 - np.take_along_axis(near, cand, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, axis=1), np.take_along_axis(far, order, axis=1)
    open_ = np.ones((m, c), dtype=bool)
    out = np.full((m, min(DEGREE, c)), -1)
    for r in range(out.shape[1]):
        pick = open_.argmax(axis=1)
        ok = open_[rows, pick]
        if not ok.any():
            break
        node = cand[rows, pick]
        out[ok, r] = node[ok]
        open_[rows, pick] = False
        open_ &= ~((ALPHA * (1 - near[node[:, None], cand]) <= far) & ok[:, None])
    count = (near >= limit).sum(axis=1)
    crowded = np.flatnonzero(count > DEGREE)
    if not len(crowded):
        return out
    wide = np.full((m, DEGREE), -1)
    for i in range(0, len(crowded), 256):
        at = crowded[i : i + 256]
        place = DEGREE + ((count[at] - DEGREE)[:, None] * (np.arange(DEGREE) + 0.5) / DEGREE).astype(int)
        wide[at] = np.take_along_axis(np.argsort(-near[at], axis=1, kind="stable"), place, axis=1)
    return np.hstack([out, wide])


def _cosines(x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 65536]], x[n[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])


def search(x: np.ndarray, nbrs: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with cosine >= limit, each row of ``x`` being a query: a greedy search from the medoid to the query's
    surroundings, then expansion through all nodes not over SLACK below the limit. ``nbrs``: rows of neighbours, -1 for none."""
    m = len(x)
    rows = np.arange(m)
    start = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((m, m), dtype=bool)
    beam = np.full((m, BEAM), -1)
    value = np.full((m, BEAM), -3.0)
    done = np.ones((m, BEAM), dtype=bool)
    beam[:, 0], value[:, 0], done[:, 0] = start, x @ x[start], False
    seen[:, start] = True
    found_q, found_n = [rows[value[:, 0] >= limit - SLACK]], [np.full(int((value[:, 0] >= limit - SLACK).sum()), start)]
    for _ in range(4 * BEAM):
        open_ = np.where(done, -4.0, value)
        pick = open_.argmax(axis=1)
        act = np.flatnonzero(~done[rows, pick])
        if not len(act):
            break
        done[act, pick[act]] = True
        n = nbrs[beam[act, pick[act]]]
        q = np.repeat(act, n.shape[1])
        n = n.ravel()
        ok = n >= 0
        q, n = q[ok], n[ok]
        fresh = ~seen[q, n]
        q, n = q[fresh], n[fresh]
        seen[q, n] = True
        s = _cosines(x, q, n)
        hit = s >= limit - SLACK
        found_q.append(q[hit])
        found_n.append(n[hit])
        width = np.bincount(q, minlength=m)
        wide = int(width.max(initial=0))
        more, more_s = np.full((m, wide), -1), np.full((m, wide), -3.0)
        place = np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width)
        more[q, place], more_s[q, place] = n, s
        beam, value, done = np.hstack([beam, more]), np.hstack([value, more_s]), np.hstack([done, more < 0])
        top = np.argsort(-value, axis=1, kind="stable")[:, :BEAM]
        beam, value, done = (np.take_along_axis(t, top, axis=1) for t in (beam, value, done))
    # The query is a node itself: where the greedy search has not come to it, expansion begins there too.
    lost = rows[~seen[rows, rows]]
    seen[lost, lost] = True
    q, n = np.concatenate([*found_q, lost]), np.concatenate([*found_n, lost])
    out_q, out_n = [q], [n]
    step = max(1, (1 << 20) // nbrs.shape[1])
    while len(q):
        next_q, next_n = [], []
        for i in range(0, len(q), step):  # a dense group has far more edges than nodes: a slice of them at once
            at, to = np.repeat(q[i : i + step], nbrs.shape[1]), nbrs[n[i : i + step]].ravel()
            ok = to >= 0
            at, to = at[ok], to[ok]
            fresh = ~seen[at, to]
            both = np.unique(at[fresh] * m + to[fresh])
            at, to = both // m, both % m
            seen[at, to] = True
            s = _cosines(x, at, to)
            next_q.append(at[s >= limit - SLACK])
            next_n.append(to[s >= limit - SLACK])
        q, n = np.concatenate(next_q), np.concatenate(next_n)
        out_q.append(q)
        out_n.append(n)
    q, n = np.concatenate(out_q), np.concatenate(out_n)
    both = np.unique(np.concatenate([q * m + n, n * m + q]))
    q, n = both // m, both % m
    ok = (_cosines(x, q, n) >= limit) & (q != n)
    return q[ok], n[ok]


def _clustered(nodes: DataFrame, overlap: int, first: int, n: int) -> DataFrame:
    """node, size, x, clusters of ``n`` nodes of one length: the ``overlap`` nearest of at most MOST_CLUSTERS clusters, numbered from ``first``."""
    share = min(1.0, SAMPLE / max(1, n))
    sample = nodes.where(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("node").limit(2 * SAMPLE)
    rows = unit([r.x for r in sample.select("x").collect()] or [nodes.select("x").first().x])
    k = max(1, min(MOST_CLUSTERS, n // CLUSTER, len(rows) // 4))
    sent = nodes.sparkSession.sparkContext.broadcast(centroids(rows, k))
    most = min(overlap, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(np.array(batch.column(2).flatten(), dtype=float).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, sent.value.shape[1]))
            near = x @ sent.value.T
            own = (first + np.sort(np.argpartition(-near, most - 1, axis=1)[:, :most], axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * most), pa.array(own.ravel()))], names=["node", "size", "x", "clusters"])

    kind = dict(nodes.dtypes)["x"]
    return nodes.select("node", "size", "x").mapInArrow(assign, f"node bigint, size bigint, x {kind}, clusters array<int>")


def _spread(nodes: DataFrame, overlap: int) -> DataFrame:
    """node, size, x, clusters, c, b, own, i, j: every node in the groups (blocks i < j of cluster c; i = j where a cluster is one
    block) of its ``overlap`` nearest clusters. A cluster over half of GROUP is split into blocks by a hash, and each two
    blocks make a group, so every two nodes of a cluster meet in a group of bounded size however large the cluster is.
    Vectors meet those of their own length: lengths that at least MANY vectors have are clustered each, any other one is a cluster of its own."""
    many = nodes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= MANY).orderBy(F.desc("n"), "d").collect()
    few = nodes.where(~F.size("x").isin([r.d for r in many])) if many else nodes
    assigned = few.select("node", "size", "x", F.array(-F.size("x")).alias("clusters"))
    for i, r in enumerate(many):
        assigned = assigned.unionByName(_clustered(nodes.where(F.size("x") == r.d), overlap, i * MOST_CLUSTERS, r.n))
    assigned = keep(assigned)
    blocks = assigned.select(F.explode("clusters").alias("c")).groupBy("c").agg(F.ceil(F.count("*") * 2 / GROUP).cast("int").alias("b"))
    rows = assigned.withColumn("c", F.explode("clusters")).join(blocks, "c").withColumn("own", F.expr("pmod(xxhash64(node), b)"))
    pairs = F.expr("if(b = 1, array(0), filter(sequence(0, b - 1), y -> y <> own))")
    rows = rows.withColumn("other", F.explode(pairs))
    return rows.select("node", "size", "x", "clusters", "c", "b", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _matrix(table: pa.Table, name: str = "x") -> np.ndarray:
    return unit(np.array(table.column(name).combine_chunks().flatten(), dtype=float).reshape(table.num_rows, -1))


def _graph(spread: DataFrame, limit: float) -> DataFrame:
    """node, nbrs: each group's robust-pruned graph with its edges in both directions, united over all groups."""

    def build(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        out = pruned(_matrix(table), limit)
        at, to = np.repeat(np.arange(len(node)), out.shape[1]), out.ravel()
        at, to = at[to >= 0], to[to >= 0]
        at, to = np.concatenate([at, to]), np.concatenate([to, at])
        order = np.argsort(at, kind="stable")
        stop = np.append(0, np.cumsum(np.bincount(at, minlength=len(node)))).astype(np.int32)
        return pa.table({"node": node, "nbrs": pa.ListArray.from_arrays(pa.array(stop), pa.array(node[to[order]]))})

    edges = spread.groupBy("c", "i", "j").applyInArrow(build, "node bigint, nbrs array<bigint>")
    return edges.select("node", F.explode("nbrs").alias("nbr")).distinct().groupBy("node").agg(F.collect_list("nbr").alias("nbrs"))


def _links(spread: DataFrame, graph: DataFrame, limit: float) -> DataFrame:
    """node, links, root per group: linked vectors (copies of a node counted), and the smallest node that links in this group
    reach. Every two nodes are counted in one group: of their first common cluster, and of two nodes in one block in the first
    group of that block."""

    def find(table: pa.Table) -> pa.Table:
        node, size, own = (table.column(c).to_numpy() for c in ("node", "size", "own"))
        x, m = _matrix(table), table.num_rows
        place = {v: i for i, v in enumerate(node.tolist())}
        lists = [[place[v] for v in row or () if v in place] for row in table.column("nbrs").to_pylist()]
        nbrs = np.full((m, max(1, max(map(len, lists)))), -1)
        for i, row in enumerate(lists):
            nbrs[i, : len(row)] = row
        q, n = search(x, nbrs, limit)
        c, i, j, b = (table.column(name)[0].as_py() for name in ("c", "i", "j", "b"))
        clusters = np.array(table.column("clusters").combine_chunks().flatten()).reshape(m, -1)
        common = (clusters[q][:, :, None] == clusters[n][:, None, :]).any(axis=2)
        ours = clusters[q][np.arange(len(q)), common.argmax(axis=1)] == c
        if b > 1:
            same = own[q] == own[n]
            home = ((own[q] == i) & (j == i + 1)) | ((own[q] == j) & (j == b - 1) & (i == b - 2))
            ours &= ~same | home
        q, n = q[ours], n[ours]
        root = np.arange(m)
        while True:
            low = root.copy()
            np.minimum.at(low, q, root[n])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.table({"node": node, "links": np.bincount(q, weights=size[n], minlength=m).astype(np.int64), "root": node[root]})

    rows = spread.join(graph, "node", "left")
    return rows.groupBy("c", "i", "j").applyInArrow(find, "node bigint, links bigint, root bigint")


def audit(nodes: DataFrame, found: DataFrame, limit: float) -> float | None:
    """The mean share of a node's links that ``found`` (node, links) has, over nodes with links, drawn by hash; the truth is by brute
    force over all nodes. AUDIT nodes are drawn, and four times as many, DRAWS times at most, where too few have links;
    a node counts as one however many links it has, so small families weigh as much as large ones. None where no node drawn has any link."""
    n = nodes.count()
    both = None
    for draw in range(DRAWS):
        most = AUDIT * 4**draw
        asked = nodes.where(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < (1 << 30) * min(1.0, most / max(1, n))).orderBy("node").limit(2 * most).select("node", "x").collect()
        if not asked:
            continue
        truth = _brute_links(nodes, [(r.node, r.x) for r in asked], limit).where("truth > 0")
        share = F.least(F.coalesce("links", F.lit(0)), "truth") / F.col("truth")
        both = truth.join(found.select("node", "links"), "node", "left").agg(F.avg(share).alias("recall"), F.count("*").alias("n")).first()
        if both["n"] >= AUDIT_LINKED or most >= n:
            break
    return both["recall"] if both else None


def _brute_links(nodes: DataFrame, asked: list[tuple[int, list[float]]], limit: float) -> DataFrame:
    """node, truth: the links of the nodes ``asked`` (node, vector) with all others of their length."""
    by_length: dict[int, tuple[list, list]] = {}
    for node, x in asked:
        ids, rows = by_length.setdefault(len(x), ([], []))
        ids.append(node)
        rows.append(x)
    sent = nodes.sparkSession.sparkContext.broadcast({d: (np.array(ids), unit(rows)) for d, (ids, rows) in by_length.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), dtype=np.int64) for d, (ids, _) in sent.value.items()}
        for batch in batches:
            length = pc.list_value_length(batch.column(2)).to_numpy()
            for d, (ids, rows) in sent.value.items():
                same = np.flatnonzero(length == d)
                for lo in range(0, len(same), 1024):
                    part = batch.take(pa.array(same[lo : lo + 1024]))
                    node, size = (part.column(i).to_numpy() for i in (0, 1))
                    near = rows @ unit(np.array(part.column(2).flatten(), dtype=float).reshape(part.num_rows, -1)).T >= limit
                    total[d] += (near & (node[None, :] != ids[:, None])) @ size
        for d, (ids, _) in sent.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[d])], names=["node", "links"])

    return nodes.select("node", "size", "x").mapInArrow(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("truth"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = 0.95, least_recall: float = 0.95, never_under: float = 0.9) -> DataFrame:
    """``key``, n_links, component_id, kept, recall per row of ``vectors``.

    Rows are linked when the cosine in double precision is at least ``limit``; n_links counts other rows linked
    directly, copies included; component_id is the smallest key that links reach. Equal vectors are one node of the
    graph and linked with each other. Vectors of different lengths aren't linked; those of every length are searched. Vectors that are null, empty, zero, or hold null or
    non-finite components have no links. The recall of a bounded sample of nodes is measured by brute force, and the
    graph is built with more overlap where it is under ``least_recall``; a recall still under ``never_under`` is an error. ``recall`` is
    the one measured, null where no node of the sample has a link. Repeated rows count each other as links; a
    null key is larger than any other; an empty table gives no rows. Other columns are not read.
    """
    numbers = F.col("x")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>" if "float" in dict(vectors.dtypes)[vector] else "array<double>").alias("x"))
    fine = numbers.isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes = keep(rows.where("fine").groupBy("x").agg(F.min("key").alias("low"), F.count("*").alias("size")).select(F.monotonically_increasing_id().alias("node"), "size", "x", "low"))
    for overlap in (2, 4, 8):
        spread = keep(_spread(nodes, overlap))
        parts = keep(_links(spread, keep(_graph(spread, limit)), limit))
        found = keep(parts.groupBy("node").agg(F.sum("links").alias("links")))
        recall = audit(nodes, found, limit)
        if recall is None or recall >= least_recall:
            break
    if recall is not None and recall < never_under:
        raise RuntimeError(f"near_duplicates: of the audited nodes' links {recall:.3f} were found, with the greatest overlap")
    roots = components(parts.select("node", "root"), "node", "root").select(F.col("node").alias("at"), "root")
    named = nodes.join(found, "node").join(roots, F.col("node") == F.col("at"), "left").select("node", "x", "low", "size", "links", F.coalesce("root", "node").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = keep(named.join(low, "root").select("x", "size", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id"))
    # A vector that very many rows share is dealt to SALTS tasks; there is one such vector in HOT rows at most.
    hot = F.broadcast(named.where(F.col("size") >= HOT).select(F.xxhash64("x").alias("h"), F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit("salt"), "key"), F.lit(SALTS))).otherwise(0).cast("int")
    own = rows.where("fine").withColumn("h", F.xxhash64("x")).join(hot, "h", "left").select("key", "x", salt.alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = named.withColumn("h", F.xxhash64("x")).join(hot, "h", "left").select("x", "n_links", "component_id", F.explode(salts).alias("salt"))
    out = own.join(dealt, ["x", "salt"]).select("key", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"))
