"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.scratch import keep

#: log2 of a sketch's registers, and the relative error (four standard deviations) outside which an estimate decides alone.
LOG_REGISTERS, ERROR = 8, 4 * 1.04 / 2**4


def _row(key: str, text: str) -> list[Column]:
    return [F.col(key).alias("__key"), F.xxhash64(text).alias("__text")]


def _occurrences(docs: DataFrame, key: str, text: str, site: str, min_chars: int) -> DataFrame:
    """One row for each line of at least ``min_chars`` characters, blanks, tabs and returns at its ends apart."""
    lines = docs.select(*_row(key, text), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("__site"), F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    line = F.btrim("__line", F.lit(" \t\r"))
    lines = lines.select("__key", "__text", "__site", "__pos", line.alias("__line")).where(F.length("__line") >= min_chars)
    return lines.select("__key", "__text", "__site", "__pos", F.xxhash64("__line").alias("__h"), F.crc32(F.col("__line").cast("binary")).alias("__c"), F.length("__line").alias("__n"))


def spread_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 3, min_chars: int = 10) -> DataFrame:
    """__h, __c (hashes of a line), __first (its smallest key): lines which at least ``min_sites`` distinct sites have.

    Each task sketches the sites of its lines, the sketches of a line are merged, and only a line whose estimate is
    within ``ERROR`` of the threshold has its distinct (line, site) pairs counted.
    """
    found = _occurrences(docs, key, text, site, min_chars)
    sketch = keep(
        found.groupBy("__h", "__c")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", LOG_REGISTERS)).alias("__sites"), F.count("*").alias("__rows"), F.min("__key").alias("__first"))
        .where((F.col("__rows") >= min_sites) & (F.col("__sites") >= int(min_sites * (1 - ERROR))))
    )
    near = F.col("__sites").between(int(min_sites * (1 - ERROR)), int(min_sites * (1 + ERROR)) + 1)
    exact = found.join(sketch.where(near).select("__h", "__c"), ["__h", "__c"]).select("__h", "__c", "__site").distinct().groupBy("__h", "__c").agg(F.count("*").alias("__exact"))
    sure = sketch.where(~near).select("__h", "__c", "__first")
    return sure.unionByName(sketch.join(exact.where(F.col("__exact") >= min_sites), ["__h", "__c"]).select("__h", "__c", "__first"))


def _copies(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """__k, __t of documents whose counted lines are, as a set, those of a document with another key."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\r"))), lambda line: F.length(line) >= min_chars)
    rows = docs.select(*_row(key, text), F.array_sort(F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))).alias("__set")).where(F.size("__set") > 0)
    rows = rows.select(F.col("__key").alias("__k"), F.col("__text").alias("__t"), F.xxhash64("__set").alias("__s"), F.hash("__set").alias("__s2"))
    shared = rows.groupBy("__s", "__s2").agg(F.min("__k").alias("__low"), F.max("__k").alias("__high")).where("__low <> __high").select("__s", "__s2")
    return rows.join(shared, ["__s", "__s2"]).select("__k", "__t").distinct()


def drop_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 3, min_chars: int = 10, most_removed: float = 0.5, only_copies: bool = True) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and before it two columns __n_lines and __n_removed.

    A line (text between newlines, compared without blanks at its ends, of ``min_chars`` characters or more) goes
    where ``min_sites`` distinct sites have it, but stays in the document with the smallest key that has it, so that
    no line is lost to the corpus. A column of ``docs`` named as one of the two counts is kept and that count left out. A document whose lines to go are over ``most_removed`` of the characters of its
    text stays whole, for a near-duplicate operator, where it is a copy: its counted lines are, as a set, those of a
    document with another key. Without ``only_copies`` it stays whole in any case (the rule of op10's SQL). A null site
    is the empty one, a null text stays null and has no lines, an empty one has one. Repeated rows give equal
    results. Rows without a key lose all such lines.
    """
    spread = keep(spread_lines(docs, key, text, site, min_sites, min_chars))
    hit = _occurrences(docs, key, text, site, min_chars).join(spread, ["__h", "__c"]).where(~F.col("__key").eqNullSafe(F.col("__first")))
    gone = hit.groupBy("__key", "__text").agg(F.collect_set("__pos").alias("__gone"), F.sum("__n").alias("__hit"), F.count("*").alias("__all"))
    gone = gone.withColumn("__hit", F.col("__hit") * F.size("__gone") / F.col("__all"))  # repeated rows count once
    gone = gone.select(F.col("__key").alias("__k"), F.col("__text").alias("__t"), "__gone", "__hit")
    copy = F.lit(True)
    if only_copies:
        copies = _copies(docs, key, text, min_chars).select(F.col("__k").alias("__ck"), F.col("__t").alias("__ct"))
        gone = gone.join(copies, F.col("__k").eqNullSafe(F.col("__ck")) & (F.col("__t") == F.col("__ct")), "left")
        copy = F.col("__ct").isNotNull()
    gone = gone.withColumn("__copy", copy)
    body = F.col("own")[text]  # the caller's columns stay in a struct, so that their names can't clash with those here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(text).alias("__text"))
    own = own.join(gone, F.col("own")[key].eqNullSafe(F.col("__k")) & (F.col("__text") == F.col("__t")), "left")
    go = F.col("__gone").isNotNull() & ((F.col("__hit") <= most_removed * F.length(body)) | ~F.col("__copy"))
    left = F.array_join(F.filter(F.split(body, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    counts = {"__n_lines": F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n", -1))).cast("bigint"), "__n_removed": F.when(go, F.size("__gone")).otherwise(0).cast("bigint")}
    return own.select(*[c.alias(n) for n, c in counts.items() if n not in docs.columns], *[F.when(go, left).otherwise(body).alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns])
