"""Jaccard self-join of documents on word shingles by parity sketches.

Each distinct shingle set becomes rows of 64-bit parity words: a shingle's hash picks one block and toggles one bit of
its word. The Hamming distance of two sketches is at most the sets' symmetric difference, which for similarity s is at
most t = (1-s)/(1+s) of the sizes' sum. Blocks are taken three by three, and two words of such a triple are a key: equal
triples share three keys, triples with one differing word share one. So of T triples, sets with at most t differing
words share 3T-2t keys at least, or 2T-t where t > T; a band of sizes has as many triples as make that positive for
its largest sets. Keys are joined, and the pairs found are verified on the exact sets. Sets of one size band meet
those of their own and of the next band, each time with the triples of the smaller one's band.

Two sets that share k keys at least still share one when each leaves out its first k-1, in an order that is the same
for all sets: first the empty ones, which say nothing, then the keys that the most sets have. How many a set may leave
out follows from its own size, as the bound is over the sets that can be similar to it. So a passage that many
documents share doesn't bring all of them together, nor do a few keys that two documents share by chance.

Copies (equal sets) are one class and are joined once. Documents with the same key form a group, of which
those stay whose sketch is near that of another member, compared within the task. Each
member is compared with the one of its groups' most central members (those that share most keys with others) with
which it shares most keys, and again where that leaves a group in more than one component. At last the members of groups
that are still in different components meet in one task with their texts, which verifies every pair whose sketches
don't differ in more bits than similar sets may, until no pair is left that would join two components: every link
that matters is tried, so the components are exact, and a task returns fewer links than it has members. Groups that
near members join are one family there, so a text is sent once and not for each key that its set shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.components import components
from transit_spark.llm.scratch import Held, discard, keep, release
from transit_spark.llm.wanted import maybe_wanted

_U = np.uint64
#: Entries (a key, a class) that one task sorts at once, and those a task holds before it sends them.
BUCKET_ENTRIES, FLUSH_ENTRIES = 50_000, 500_000
MOST_BUCKETS = 1 << 30
#: Bits of s1 that stand for a class on the way; classes which have them in common are told apart by their sketches.
CLASS_BITS = 36
#: One entry of 64 bits: part of a key (its bucket has more of it), a class, and a bit which tells that the key is of the band below the class's own.
OWNER_BITS = CLASS_BITS + 1
ENTRY = np.dtype("<u8")
#: Blocks whose words make keys together; all but one of them make one.
GROUPED = 3
#: Rounds in which members are compared with the most central one of a group, and groups of each member, those in which it
#: shares most keys, that take part; what they leave apart is joined by the last step, which takes all groups.
STARS, STAR_GROUPS = 2, 8
#: Members of a group that one task compares with each other, and shingles it holds for that.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


def bands(percent: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each band, and the triples for pairs whose smaller set is in the band (none: only equal sets are similar)."""
    low, triples = [1], []
    while low[-1] < largest:
        low.append(max(low[-1] + 1, low[-1] * 100 // percent))
        a = low[-1] - 1
        t = (100 - percent) * (a + a * 100 // percent) // (100 + percent)
        triples.append(t // 2 + 2 + t // 16 if t else 0)
    return np.array(low[:-1]), np.array(triples)


def spares(n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(band, triples, keys that may be left out) of sets of ``n`` shingles, in their own band and in the one below; no triples: no keys."""
    low, triples = bands(percent)
    own = np.maximum(np.searchsorted(low, n, "right") - 1, 0)
    for back, other in ((0, n * 100 // percent), (1, low[own] - 1)):
        band = own - back
        t = (100 - percent) * (n + other) // (100 + percent)
        many = np.where((band >= 0) & (n > 0), triples[np.maximum(band, 0)], 0)
        yield band, many, np.where(t <= many, 3 * many - 2 * t, 2 * many - t) - 1


def folded(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each set's parity sketch of at least a bit a shingle, a power of two and 64 at least; halves XORed give the next smaller one."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    stop = np.cumsum(bits)
    at = np.repeat(stop - bits, n) + ((h >> _U(7)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(stop[-1]) if len(n) else 0).astype(np.uint8) & 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, stop // 8)), pa.py_buffer(packed)]).cast(pa.binary())


def hamming(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def signatures(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, t, n_shingles, s1, s2, sketch: a hash of each row's text, the size of its shingle set, 128 bits that stand for it, its folded
    sketch, and own, below: the keys that it may leave out in its band and in the band below, and keys: how many it has at most in one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, 2):
                h, n = tx.shingles(part.column(2), width)
                s1, s2 = tx.set_ids(h, n)
                (_, many, own), (_, fewer, below) = spares(n, percent)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(s1), pa.array(s2), folded(h, n), pa.array(own), pa.array(below), pa.array(GROUPED * np.maximum(many, fewer))], names=["key", "t", "n_shingles", "s1", "s2", "sketch", "own", "below", "keys"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, t bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch binary, own bigint, below bigint, keys bigint")


def parity_keys(h: np.ndarray, n: np.ndarray, band: np.ndarray, triples: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit keys in a band, their rows) without empty keys that may stay out, and how many more each row may leave out. h: each row's sorted hashes; band, triples, spare: of each row."""
    blocks = triples * GROUPED
    used = np.flatnonzero((blocks > 0) & (n > 0))
    if not len(used):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    block = ((h >> _U(32)) * blocks[row].astype(np.uint64)) >> _U(32)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    word = np.bitwise_xor.reduceat(_U(1) << (h & _U(63)), at)
    row, block = row[at], block[at]
    full = (word != 0) & (blocks[row] > 0)
    row, block, word = row[full], block[full], word[full]
    triple, place = block // _U(GROUPED), (block % _U(GROUPED)).astype(np.int64)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (triple[1:] != triple[:-1]) | (row[1:] != row[:-1])
    words = np.zeros((int(new.sum()), GROUPED), dtype=np.uint64)
    words[np.cumsum(new) - 1, place] = tx.mix(word + tx.mix(block + _U(1)))
    row, triple = row[new], triple[new]
    rest = words.sum(axis=1, dtype=np.uint64)[:, None] - words
    number = triple[:, None] * _U(GROUPED) + np.arange(GROUPED, dtype=np.uint64) + (band[row].astype(np.uint64)[:, None] << _U(40))
    fill = rest != 0
    key, owner = tx.mix(rest + tx.mix(number + _U(1)))[fill], np.broadcast_to(row[:, None], rest.shape)[fill]
    empty = blocks - np.bincount(owner, minlength=len(n))
    for r in used[empty[used] > spare[used]]:
        own = row == r
        some = (triple[own][:, None] * _U(GROUPED) + np.arange(GROUPED, dtype=np.uint64))[fill[own]]
        zero = np.setdiff1d(np.arange(blocks[r], dtype=np.uint64), some)[: empty[r] - spare[r]]
        key = np.concatenate([key, tx.mix(tx.mix(zero + (band[r].astype(np.uint64) << _U(40)) + _U(1)))])
        owner = np.concatenate([owner, np.full(len(zero), r)])
    return key, owner, np.maximum(spare - empty, 0)


def _groups(docs: DataFrame, text: str, width: int, percent: int, buckets: int) -> DataFrame:
    """gid, times, members (sorted: c of a class, and in the last bit whether the key is of the band below its own): all sets of classes that share
    a key, and how many keys they share; c is the first CLASS_BITS of s1."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = ((key >> _U(32)) % _U(buckets)).astype(np.uint32 if buckets > 65536 else np.uint16)
            order = np.argsort(bucket, kind="stable")
            bucket, owner = bucket[order], owner[order]
            entries = (key[order] << _U(OWNER_BITS) | owner).astype(ENTRY)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.append(at[1:], len(bucket))
            for lo in range(0, len(at), 1000):
                hi = min(lo + 1000, len(at))
                cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.append(at[lo:hi], end[hi - 1]) * ENTRY.itemsize), pa.py_buffer(entries)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at[lo:hi]].astype(np.int32)), cut], names=["bucket", "entries"])

        size = 0
        for batch in batches:
            for part in tx.pieces(batch, 0):
                h, n = tx.shingles(part.column(0), width)
                s1, _ = tx.set_ids(h, n)
                _, first = np.unique(s1, return_index=True)
                fresh = np.zeros(len(n), dtype=bool)
                fresh[[i for i in first.tolist() if s1[i] not in seen]] = True
                if len(seen) < FLUSH_ENTRIES:  # only spares work: copies of one class are counted once after the shuffle
                    seen.update(s1[fresh].tolist())
                h, n, s1 = h[np.repeat(fresh, n)], n[fresh], s1[fresh]
                for below, (band, triples, spare) in enumerate(spares(n, percent)):
                    key, row, _ = parity_keys(h, n, band, triples, spare)
                    if len(key):
                        held.append((key, s1.view(np.uint64)[row] >> _U(64 - CLASS_BITS) << _U(1) | _U(below)))
                        size += len(key)
                if size >= FLUSH_ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        entries = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("entries")]))
        key, owner = entries >> _U(OWNER_BITS), entries & _U((1 << OWNER_BITS) - 1)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(at, len(key)))
        at, many = at[many > 1], many[many > 1]  # most keys come once
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(owner), dtype=np.uint64)])
        gid, first, times = np.unique(tx.mix(sums[at + many] - sums[at] + many.astype(np.uint64)), return_index=True, return_counts=True)
        at, many = at[first], many[first]
        stop = np.cumsum(many)
        take = np.arange(many.sum()) + np.repeat(at - (stop - many), many)
        members = pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(owner[take].view(np.int64)))
        return pa.table({"gid": gid.view(np.int64), "times": times.astype(np.int64), "members": members})

    sent = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(send, "bucket int, entries binary")
    return sent.groupBy("bucket").applyInArrow(meet, "gid bigint, times bigint, members array<bigint>")


def _merged(keys: Column, buckets: int) -> Column:
    """How many of a set's keys may be equal to others of its own in the bits that an entry has: so many fewer may it leave out."""
    expected = keys.cast("double") * keys / (2.0 * buckets * 2 ** (64 - OWNER_BITS))
    return F.when(expected < 1e-6, 0).when(expected < 1e-3, 1).otherwise(4 + F.ceil(4 * expected))


def _members(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """gid, size, times, node, n, sketch: members of groups, without the keys that each class may leave out (those of the largest
    groups go first), with the size of the group as it was, and the size and sketch of the class."""
    rows = groups.select("gid", F.explode("members").alias("m"), F.size("members").alias("size"), "times")
    # Most groups are found in one bucket, so buckets' rows of a group are summed where its members' classes are, not before.
    rows = rows.select("gid", F.shiftright("m", 1).alias("c"), (F.col("m") % 2 == 1).alias("lower"), "size", "times").repartition("c")
    rows = rows.groupBy("c", "gid", "lower", "size").agg(F.sum("times").alias("times")).join(classes, "c")
    rows = rows.withColumn("spare", F.when(F.col("lower"), F.col("below")).otherwise(F.col("own")))
    left_out = F.sum("times").over(W.partitionBy("c", "node", "lower").orderBy(F.desc("size"), "gid").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("out", left_out).where("out > spare").select("gid", "size", F.expr("least(times, out - spare)").cast("int").alias("times"), "node", "n", "sketch")


def _split(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``member`` in groups of more than one component, with label, the component."""
    named = member.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gid")
    return named.join(mixed, "gid")


def _folded(sketch: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, the wider ones folded to the narrowest."""
    width = np.array([len(x) for x in sketch], dtype=np.int64) // 8
    words = np.zeros((len(sketch), width.min(initial=1 << 40) if len(sketch) else 1), dtype=np.uint64)
    for v in np.unique(width):
        at = np.flatnonzero(width == v)
        words[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([sketch[i] for i in at.tolist()]), np.uint64).reshape(len(at), v // words.shape[1], words.shape[1]), axis=1)
    return words


def _compared(label: np.ndarray | None, n: np.ndarray, sketch: list[bytes], run: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in one run whose labels differ (if there are any), whose sizes fit and whose sketches are near."""
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    many = np.diff(np.append(start, len(run)))
    width = np.array([len(x) for x in sketch]) // 8
    least = np.minimum.reduceat(width, start)
    limit = (100 - percent) * n
    out = []
    for w in np.unique(least[many > 1]):
        use = np.repeat((least == w) & (many > 1), many)
        words = np.zeros((len(n), w), dtype=np.uint64)
        for v in np.unique(width[use]):
            at = np.flatnonzero(use & (width == v))
            words[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join([sketch[i] for i in at.tolist()]), np.uint64).reshape(len(at), v // w, w), axis=1)
        for k in np.unique(many[(many > 1) & (least == w)]):
            first = start[(many == k) & (least == w)]
            step = max(1, (1 << 21) // int(k * w))
            for lo in range(0, len(first), step):
                rows = first[lo : lo + step][:, None] + np.arange(k)
                for m in range(k - 1):
                    one, rest = rows[:, m : m + 1], rows[:, m + 1 :]
                    near = 100 * np.minimum(n[one], n[rest]) >= percent * np.maximum(n[one], n[rest])
                    bits = np.bitwise_count(words[one] ^ words[rest]).sum(axis=2, dtype=np.int64)
                    near &= (100 + percent) * bits <= limit[one] + limit[rest]
                    if label is not None:
                        near &= label[one] != label[rest]
                    g, other = np.nonzero(near)
                    out.append((one[g, 0], rest[g, other]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (start[:0], start[:0])


def _dealt(member: DataFrame, *columns: str) -> DataFrame:
    """gid, part and ``columns`` of members (gid, blocks, node): a group of one block is one part; else every two blocks make one."""
    rows = member.withColumn("own", F.expr("pmod(xxhash64(node), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("if(blocks = 1, array(own), filter(sequence(0L, blocks - 1L), x -> x <> own))")))
    return rows.select("gid", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("part"), *columns)


def _whole_parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole parts of sorted batches (gid, part, ...), of about ``most`` rows or one part each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        held = table if held is None else pa.concat_tables([held, table])
        gid, part = (held.column(x).to_numpy() for x in range(2))
        last = (gid == gid[-1]) & (part == part[-1])  # the last part may go on in the next batch
        if held.num_rows >= most and not last.all():
            done, held = held.slice(0, int(last.argmax())), held.slice(int(last.argmax()))
            yield done
    if held is not None:
        yield held


def _runs(table: pa.Table) -> np.ndarray:
    gid, part = (table.column(x).to_numpy() for x in range(2))
    return np.cumsum(np.concatenate([[True], (gid[1:] != gid[:-1]) | (part[1:] != part[:-1])]))


def _reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` rows that pairs (a, b) lead to from each."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _near_members(member: DataFrame, percent: int, labels: bool) -> DataFrame:
    """gid, size, times, node of those members (gid, size, times, node, n, sketch; label with ``labels``) whose size fits and whose
    sketch is near that of another member of the group, with another label. Only members leave the task, never pairs.
    With ``labels`` a gid stands for the members that near sketches join, so equal sets of different groups are one, and
    instead of size and times a row has hub, the smallest of these members.
    A group of over BLOCK members is dealt into blocks, so that no task holds a whole large one."""
    rows = _dealt(member.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("bigint")), "node", "n", "times", "sketch", "size", *["label"] * labels)
    rows = rows.repartition("gid", "part").sortWithinPartitions("gid", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_parts(batches, 20_000):
            a, b = _compared(t.column(7).to_numpy() if labels else None, t.column(3).to_numpy(), t.column(5).to_pylist(), _runs(t), percent)
            at = np.unique(np.concatenate([a, b]))
            gid, node = t.column(0).to_numpy()[at], t.column(2).to_numpy()[at]
            if labels:
                root = _reached(a, b, t.num_rows)[at]
                total = np.zeros(t.num_rows, dtype=np.uint64)
                np.add.at(total, root, tx.mix(node.astype(np.uint64)))
                hub = np.full(t.num_rows, np.iinfo(np.int64).max)
                np.minimum.at(hub, root, node)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tx.mix(total)[root].view(np.int64), hub[root], node)], names=["gid", "hub", "node"])
                continue
            size, times = (t.column(i).combine_chunks().take(pa.array(at)) for i in (6, 4))
            yield pa.RecordBatch.from_arrays([pa.array(gid), size, times, pa.array(node)], names=["gid", "size", "times", "node"])

    return rows.mapInArrow(run, "gid bigint, hub bigint, node bigint" if labels else "gid bigint, size int, times int, node bigint")


def _blocks() -> Column:
    """Into how many blocks a group of members (node, n) is dealt."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("bigint")


def _families(near: DataFrame, facts: DataFrame) -> DataFrame:
    """gid, node, n, sketch of members (gid, hub, node) with a gid for all groups that have members in common, so that each is one row
    and not one for each of its groups; but groups stay as they are where that sends fewer texts, as large families go to many parts."""
    near = keep(near.distinct())
    found = components(near, "hub", "node")
    rows = near.select("gid", "node").distinct().join(found.withColumnRenamed("root", "family"), "node", "left").join(facts, "node")
    rows = keep(rows.select("gid", "node", F.coalesce("family", "node").alias("family"), "n", "sketch"))
    sent = F.count("*") * F.greatest(_blocks() - 1, F.lit(1))
    apart = rows.groupBy("family", "gid").agg(sent.alias("sent")).groupBy("family").agg(F.sum("sent").alias("apart"))
    united = rows.groupBy("family", "node").agg(F.first("n").alias("n")).groupBy("family").agg(sent.alias("united"))
    cheaper = apart.join(united, "family").select("family", (F.col("united") <= F.col("apart")).alias("one"))
    out = keep(rows.join(cheaper, "family").select(F.when(F.col("one"), F.xxhash64("family")).otherwise(F.col("gid")).alias("gid"), "node", "n", "sketch").dropDuplicates(["gid", "node"]))
    discard(near, found, rows)
    return out


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """node, s1, s2, text of ``wanted`` (node, rep, s1, s2), a row for every document with the key ``rep``; texts of other documents are not shuffled."""
    rows = maybe_wanted(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key", wanted, "rep", 64)
    return rows.join(wanted, F.col("key").eqNullSafe(F.col("rep"))).select("node", "s1", "s2", "text")


def _same(s1: np.ndarray, s2: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    """Whether a row's text has the set that its class states: another document may have the same key."""
    return (s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy())


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of sets of sorted hashes."""
    found = np.searchsorted(x, y)
    both = int((x[np.minimum(found, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(docs: DataFrame, key: str, text: str, width: int, percent: int, classes: DataFrame, pairs: DataFrame, held: Held) -> DataFrame:
    """a, b of ``pairs`` (a, b: nodes) with similar sets. Texts are sent once for each pair; a hub's once for 64 pairs."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}"))
    named = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    named = named.select("a", "b", F.expr(f"{100 - percent} * (na + nb) div {100 + percent}").alias("most"), "sketcha", "sketchb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [hamming(x, y) <= t for t, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    named = held.keep(named.mapInArrow(near, "a bigint, b bigint"))
    parts = named.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
    named = named.join(parts, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    want = held.keep(named.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(named.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("role")).distinct()))
    asked = held.keep(classes.join(want.select("node").distinct(), "node", "left_semi").select("node", "rep", "s1", "s2"))
    rows = want.join(_texts(docs, key, text, asked), "node").repartition("a", "part").sortWithinPartitions("a", "part", "role", "node").select("a", "part", "role", "node", "text", "s1", "s2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            for part in tx.pieces(batch, 4):
                h, n = tx.shingles(part.column(4), width)
                fine = _same(*tx.set_ids(h, n), part)
                stop, out = np.cumsum(n).tolist(), []
                a, p, role, node = (part.column(i).to_pylist() for i in range(4))
                for i in np.flatnonzero(fine).tolist():
                    own = h[stop[i] - int(n[i]) : stop[i]]
                    if role[i] == 0:
                        at, hub = (a[i], p[i]), own.copy()
                    elif at == (a[i], p[i]) and _similar(hub, own, percent):
                        out.append((a[i], node[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(verify, "a bigint, b bigint").distinct()


def _joining(docs: DataFrame, key: str, text: str, width: int, percent: int, classes: DataFrame, member: DataFrame, held: Held) -> DataFrame:
    """a, b: links between the components of each group's members (gid, node, label, n, sketch), enough to join all that links
    of the group join. The members' texts meet in a task, a part of a group at a time, which verifies pairs of near
    sketches, the nearest first, and leaves out those whose components are joined already."""
    size = member.groupBy("gid").agg(_blocks().alias("blocks"))
    asked = held.keep(classes.join(member.select("node").distinct(), "node", "left_semi").select("node", "rep", "s1", "s2"))
    rows = _dealt(member.join(size, "gid"), "node", "label", "n", "sketch").join(_texts(docs, key, text, asked), "node")
    rows = rows.repartition("gid", "part").sortWithinPartitions("gid", "part", "node").select("gid", "part", "node", "label", "n", "sketch", "s1", "s2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_parts(batches, 1):
            at = np.flatnonzero(np.diff(np.concatenate([[0], _runs(t)])))
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(t.slice(lo, hi - lo).combine_chunks().to_batches()[0])], names=["a", "b"])

    def links(part: pa.RecordBatch) -> tuple[list[int], list[int]]:
        h, n = tx.shingles(part.column("text"), width)
        stop = np.cumsum(n)
        fine = np.flatnonzero(_same(*tx.set_ids(h, n), part))
        fine = fine[np.unique(part.column("node").to_numpy()[fine], return_index=True)[1]]
        sets = [h[stop[i] - n[i] : stop[i]] for i in fine]
        node, label, sketch = part.column("node").to_numpy()[fine], part.column("label").to_numpy()[fine], [part.column("sketch")[i].as_py() for i in fine.tolist()]
        size, words, out = n[fine], _folded(sketch), ([], [])
        # Pairs that a link would join are tried row by row, the nearest first; a row that is joined leaves the others no pair to try.
        joined = np.unique(label, return_inverse=True)[1]
        for i in range(len(fine) - 1):
            at = i + 1 + np.flatnonzero((joined[i + 1 :] != joined[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])))
            bits = np.bitwise_count(words[i] ^ words[at]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * bits <= (100 - percent) * (size[i] + size[at])
            for j in at[near][np.argsort(bits[near], kind="stable")].tolist():
                if joined[j] != joined[i] and _similar(sets[i], sets[j], percent):
                    joined[joined == joined[j]] = joined[i]
                    out[0].append(int(node[i]))
                    out[1].append(int(node[j]))
        return out

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _labelled(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, t (a hash of the text), n_shingles, component_id of every row."""
    kept = keep(signatures(docs, key, text, width, percent))
    total = kept.agg(F.sum("n_shingles")).first()[0] or 0
    classes = kept.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("sketch", "own", "below", "keys")])
    classes = keep(classes.select(F.monotonically_increasing_id().alias("node"), "*"))
    buckets = int(min(MOST_BUCKETS, max(1, total * 0.75 // BUCKET_ENTRIES)))
    groups = keep(_groups(docs, text, width, percent, buckets))
    release(docs.sparkSession)
    held = classes.select(F.shiftrightunsigned("s1", 64 - CLASS_BITS).alias("c"), "node", "n", "sketch", *[F.greatest(F.col(c) - _merged(F.col("keys"), buckets), F.lit(0)).alias(c) for c in ("own", "below")])
    member = keep(_near_members(_members(groups, held), percent, False).distinct())
    discard(groups)
    release(docs.sparkSession)
    own = W.partitionBy("node")
    shared = F.col("times") * (F.col("size") - 1)
    starred = member.withColumns({"degree": F.sum(shared).over(own), "place": F.row_number().over(own.orderBy(F.desc(shared), "gid"))})
    starred = keep(starred.where(F.col("place") <= STAR_GROUPS).select("gid", "times", "node", "degree"))
    release(docs.sparkSession)
    tried = links = roots = None
    for _ in range(STARS):
        rows, step = starred if roots is None else _split(starred, roots), Held()
        hub = rows.groupBy("gid").agg(F.max(F.struct("degree", "node")).alias("hub")).select("gid", F.col("hub.node").alias("a"))
        star = rows.select("gid", "times", F.col("node").alias("b")).join(hub, "gid").where("a <> b").groupBy("a", "b").agg(F.sum("times").alias("times"))
        star = star if tried is None else star.join(tried, ["a", "b"], "left_anti")
        star = keep(star.groupBy("b").agg(F.max(F.struct("times", "a")).alias("best")).select("best.a", "b"))
        more = _verified(docs, key, text, width, percent, classes, star, step)
        old = [x for x in (tried, links, roots) if x is not None]
        tried = star if tried is None else keep(tried.unionByName(star))
        links = keep(more if links is None else links.unionByName(more))
        roots = keep(components(links, "a", "b"))
        discard(*old)
        step.discard()
        release(docs.sparkSession)
    # Last, all members of a group which are still in different components.
    facts = classes.select("node", "n", "sketch")
    labelled = member.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    family = _families(_near_members(labelled.join(facts, "node").select("gid", "size", "times", "node", "n", "sketch", "label"), percent, True), facts)
    cross = family.join(roots.withColumnRenamed("root", "label"), "node", "left")
    cross = keep(cross.select("gid", "node", F.coalesce("label", "node").alias("label"), "n", "sketch"))
    discard(member, starred, tried, family)
    release(docs.sparkSession)
    if cross.limit(1).count():
        step = Held()
        whole = keep(links.unionByName(_joining(docs, key, text, width, percent, classes, cross, step)))
        discard(links, roots)
        step.discard()
        release(docs.sparkSession)
        roots = keep(components(whole, "a", "b"))
        discard(whole)
    discard(cross)

    named = classes.join(roots, "node", "left").select("s1", "s2", "rep", F.coalesce("root", "node").alias("root"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = keep(named.join(low, "root").select("s1", "s2", "component_id"))
    out = kept.where("n_shingles > 0").join(named, ["s1", "s2"]).select("key", "t", "n_shingles", "component_id")
    return out.unionByName(kept.where("n_shingles = 0").select("key", "t", "n_shingles", F.col("key").alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id.

    Words are what ASCII white space parts, A-Z in lower case; a row's set are its distinct shingles of ``width`` words,
    or all its words where it has fewer. Rows are linked when 100 * intersection >= ``percent`` * union; component_id
    is the smallest key that links reach. Null, empty and blank texts have no shingles and no links. Repeated rows are
    rows of their own with equal results. A null key is larger than any other. Other columns are not read.
    """
    return _labelled(docs, key, text, width, percent).select(F.col("key").alias(key), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, all its columns as they are: that with the smallest key; of different texts
    of a component that have this key, one. Rows without words are linked with nothing and stay, but of rows with
    the same key and text one stays."""
    rows = _labelled(docs, key, text, width, percent).where(F.col("key").eqNullSafe(F.col("component_id")))
    chosen = rows.where("n_shingles > 0").groupBy("key", "component_id").agg(F.min("t").alias("t"), F.count("*").alias("n")).select("key", "t", "n")
    stay = keep(chosen.unionByName(rows.where("n_shingles = 0").groupBy("key", "t").agg(F.count("*").alias("n"))))
    free = "stay"  # a name that no column of docs begins with
    while any(c.lower().startswith(free) for c in docs.columns):
        free = f"_{free}"
    own = stay.select(F.col("key").alias(f"{free}_key"), F.col("t").alias(f"{free}_text"))
    out = docs.join(own, F.col(f"`{key}`").eqNullSafe(F.col(f"{free}_key")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(f"{free}_text")), "left_semi")
    return out.dropDuplicates([key, text]) if stay.where("n > 1").limit(1).count() else out
