"""Document quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import text as tx
from transit_spark.llm.scratch import keep
from transit_spark.llm.wanted import Wanted, passes

STATISTICS = ("words", "word_bytes", "upper", "mark", "digit", "distinct_words", "top_word", "words_a_line", "ended_lines", "long_words", "distinct_lines")

_UPPER, _DIGIT, _MARK, _LETTER, _NEWLINE, _END = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_NEWLINE[10] = True
_NOT_NEWLINE = ~_NEWLINE
_END[[33, 46, 63]] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text: shares by log odds or logarithms, so that each is roughly normal within a class. All are finite, for empty texts too."""
    data, at = tx.raw(column)
    size = np.diff(at)

    def count(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask[data])])
        return s[at[1:]] - s[at[:-1]]

    def distinct(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the parts, parts of each row, distinct ones, and how often the most frequent one comes."""
        start, end, n = tx.spans(data, at, word)
        up, down = tx._powers.upto(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx._BYTE[data] * up[: len(data)], dtype=np.uint64)])
        h = tx.mix((total[end] - total[start]) * down[start])
        row = np.repeat(np.arange(len(n)), n)
        stop = np.cumsum(n)
        for lo, hi in zip((stop - n).tolist(), stop.tolist(), strict=True):
            h[lo:hi].sort()
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        most = np.zeros(len(n), dtype=np.int64)
        np.maximum.at(most, row[first], np.diff(np.append(first, len(h))))
        return start, end, row, n, np.bincount(row[first], minlength=len(n)), most

    start, end, row, words, different, most = distinct(tx.NOT_SPACE)
    long = np.bincount(row[end - start > 12], minlength=len(words))
    _, line_end, line_row, lines, different_lines, _ = distinct(_NOT_NEWLINE)
    ended = np.bincount(line_row[_END[data[line_end - 1]]], minlength=len(words)) if len(line_end) else np.zeros(len(words))
    share = lambda x, n: np.log((x + 0.5) / (n - x + 0.5))
    letters = count(_LETTER)
    return np.column_stack([
        np.log1p(words), np.log((size + 1) / (words + 1)), share(count(_UPPER), letters), share(count(_MARK), size), share(count(_DIGIT), size), share(different, words),
        share(most, words), np.log((words + 1) / (lines + 1)), share(ended, lines), share(long, words), share(different_lines, lines),
    ]).astype(float)


def damped(x: np.ndarray, centre: np.ndarray, words: float = 8.0) -> np.ndarray:
    """Statistics moved towards ``centre`` where few words tell little; half-way at ``words`` of them."""
    n = np.expm1(x[:, :1])
    return centre + (x - centre) * n / (n + words)


class Discriminant:
    """Means, Cholesky factors and priors of two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], centre: np.ndarray, shrinkage: float, ridge: float = 1e-3) -> None:
        """moments: (count, sums, sums of products) of each class, of damped statistics. A class covariance is mixed
        with the pooled one and with its own mean variance, ``shrinkage`` each; so few rows of a class, and statistics
        that are constant, do."""
        k, self.centre = len(STATISTICS), centre
        size = {c: m[0] for c, m in moments.items()}
        scatter = {c: m[2] - np.outer(m[1], m[1]) / m[0] for c, m in moments.items() if m[0]}
        pooled = sum(scatter.values()) / max(1, sum(size.values()) - 2) + ridge * np.eye(k) if scatter else np.eye(k)
        self.classes = {}
        for c, s in scatter.items():
            own = s / max(1.0, size[c] - 1) + ridge * np.eye(k)
            weight = size[c] / (size[c] + 10.0 * k)
            own = (1 - shrinkage) * (weight * own + (1 - weight) * pooled) + shrinkage * pooled
            own = (1 - shrinkage) * own + shrinkage * np.trace(own) / k * np.eye(k)
            factor = np.linalg.cholesky(own)
            self.classes[c] = (moments[c][1] / size[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(size[c] / sum(size.values())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the classes' log densities; only one class known: all are of it; none: 0.5."""
        x = damped(x, self.centre)
        if set(self.classes) != {0, 1}:
            return np.full(len(x), {(0,): 0.0, (1,): 1.0}.get(tuple(self.classes), 0.5))
        log = {c: prior - 0.5 * (det + ((x - mean) @ factor.T).__pow__(2).sum(axis=1)) for c, (mean, factor, det, prior) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def held_out(key: str, folds: int = 5) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def measure(docs: DataFrame, key: str, text: str, wanted: Wanted | None = None) -> DataFrame:
    """key, x: the statistics of each row, or only of those that ``wanted`` lets pass."""
    kind = docs.schema[key].dataType.simpleString()
    sent = None if wanted is None else wanted.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch if sent is None else batch.filter(passes(sent, batch.column(2))), 1):
                x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["key", "x"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *([] if wanted is None else [wanted.place(key)]))
    return rows.mapInArrow(run, f"key {kind}, x array<double>")


def fit(measured: DataFrame, labels: DataFrame, key: str, label: str, shrinkage: float) -> Discriminant:
    """The discriminant of all labelled rows outside the held-out fold; only sums over each partition's rows are moved,
    once for the mean of both classes, which damping needs, and once for the moments."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    rows = keep(measured.join(known, "key").select("label", "x"))
    k = len(STATISTICS)
    total = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    centre = np.zeros(k)
    centre[[r.i for r in total]] = [r.v for r in total]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
        for batch in batches:
            label, x = batch.column(0).to_numpy(), damped(np.array(batch.column(1).flatten()).reshape(-1, k), centre)
            for c in held:
                own = x[label == c]
                held[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], 1 + k + k * k)), pa.array(np.tile(np.arange(1 + k + k * k), 2)), pa.array(np.concatenate([held[0], held[1]]))], names=["label", "i", "v"])

    moments = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
    for r in rows.mapInArrow(sums, "label bigint, i bigint, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        moments[r.label][r.i] = r.v
    return Discriminant({c: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for c, v in moments.items()}, centre, shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", shrinkage: float = 0.02, threshold: float = 0.3) -> DataFrame:
    """``key``, held_out, score, predicted per row of ``docs``; the score is the probability of label 1.

    Learns from all labelled rows with crc32(key) % 5 <> 0; a key labelled more than once counts as 1 if any label is.
    Only the text is an input. Null texts are empty, which has statistics like any text. Labels that are null or
    neither 0 nor 1 are left out. Repeated rows get equal scores, an empty table gives none; without labels of both
    classes the score is that of the only class, or 0.5. A null key is not held out.
    """
    measured = keep(measure(docs, key, text))
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, key, label, shrinkage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(np.array(batch.column(1).flatten()).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = measured.mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", shrinkage: float = 0.02, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``; scored in the scan, so no row is moved."""
    labelled = Wanted(labels.where(F.col(label).isin(0, 1)).select(F.col(key).cast(docs.schema[key].dataType).alias(key)), key)  # only these are measured to learn from
    model = docs.sparkSession.sparkContext.broadcast(fit(measure(docs, key, text, labelled), labels, key, label, shrinkage))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, at):
                yield part.filter(pa.array(model.value.score(statistics(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
