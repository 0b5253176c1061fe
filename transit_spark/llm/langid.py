"""Language of documents by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm import text as tx

#: Length of the vectors; documents a language from which its prototype is learned, about.
DIMENSIONS, LEARNED_DOCS = 1024, 4000
#: Texts and different trigrams whose counts are held at once.
ROWS, GRAMS = 512, 8192


@cache
def _letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([code, 2009]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)


def profiles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the trigram vectors of each text, whether it has letters). A trigram is a letter between two letters or
    word ends, its vector the product of its letters' vectors, the first rotated by two places, the second by one."""
    texts = [(x or "").lower() for x in column.to_pylist()]
    code = np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) + 2 for x in texts], dtype=np.int64)
    code = np.where(_letters()[code], code, 32)
    seen, index = np.unique(code, return_inverse=True)
    at = np.flatnonzero(code != 32)
    at = at[(at > 0) & (at < len(code) - 1)]
    row = np.repeat(np.arange(len(texts)), size)[at]
    n = len(seen)
    gram = (index[at - 1] * n + index[at]) * n + index[at + 1]
    if n**3 <= 1 << 24:
        there = np.zeros(n**3, dtype=bool)
        there[gram] = True
        grams = np.flatnonzero(there)
        number = np.zeros(n**3, dtype=np.int32)
        number[grams] = np.arange(len(grams))
        gram = number[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if not len(grams):
        return out, np.zeros(len(texts), dtype=bool)
    letters = np.stack([letter_vector(int(c)) for c in seen])
    for lo in range(0, len(grams), GRAMS):  # bounded memory for texts of many scripts
        part = grams[lo : lo + GRAMS]
        own = (gram >= lo) & (gram < lo + len(part))
        counts = np.bincount(row[own] * len(part) + gram[own] - lo, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        vectors = np.roll(letters, 2, axis=1)[part // (n * n)] * np.roll(letters, 1, axis=1)[part // n % n] * letters[part % n]
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out, np.bincount(row, minlength=len(texts)) > 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def prototypes(docs: DataFrame, key: str, text: str, lang: str, most: int) -> dict[str, np.ndarray]:
    """Each language's bundle: the sum of the unit vectors of its documents outside the held-out fold. Of a language
    with over ``most`` such documents those are taken whose hashed keys are smallest, about ``most``."""
    rows = docs.where(F.col(lang).isNotNull() & ~F.coalesce(held_out(key), F.lit(False)))
    share = {r.lang: min(1.0, most / r.n) for r in rows.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col(lang).cast("string")]
    rows = rows.where(F.pmod(F.xxhash64(F.lit("learn"), key), F.lit(1 << 20)) < limit * (1 << 20)).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tx.pieces(batch, 1, most_rows=ROWS):
                vectors, any_letter = profiles(part.column(1))
                vectors = _unit(vectors.astype(float)) * any_letter[:, None]
                names = np.array(part.column(0).to_pylist(), dtype=object)
                for name in set(names):
                    held[name] = held.get(name, 0) + vectors[names == name].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    sums = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out = {x: np.zeros(DIMENSIONS) for x in share}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).collect():  # DIMENSIONS values a language
        out[r.lang] = np.array([x.v for x in r.v])
    return {x: _unit(v) for x, v in sorted(out.items())}


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LEARNED_DOCS) -> DataFrame:
    """``key``, held_out, lang_pred, score per row of ``docs``.

    Learns from about ``most`` documents of each language, drawn by a hash of the key from those with a language and
    crc32(key) % 3 <> 1; predicts every whole text. The prediction is the language whose prototype has the greatest
    cosine, the alphabetically first of equal ones; score is that cosine, 0 at least. Texts without a letter, and null
    ones, are ``und`` with score 0, as are all where nothing can be learned. A null key is not held out; repeated rows
    have equal results.
    """
    learned = prototypes(docs, key, text, lang, most)
    sent = docs.sparkSession.sparkContext.broadcast((list(learned), np.array(list(learned.values())).reshape(-1, DIMENSIONS)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base = sent.value
        for batch in batches:
            for part in tx.pieces(batch, 1, most_rows=ROWS):
                vectors, any_letter = profiles(part.column(1))
                if names:
                    cosine = _unit(vectors.astype(float)) @ base.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(best)), best], 0, 1) * any_letter
                    said = [names[b] if ok else "und" for b, ok in zip(best.tolist(), any_letter.tolist(), strict=True)]
                else:
                    said, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.select(F.col("key").alias(key), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), "lang_pred", "score")
