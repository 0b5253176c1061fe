"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Bad documents go, boilerplate lines go, one of each group of near copies stays, documents with benchmark passages go,
and what is left is packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.llm import decontam, lines, ngram_join, packing, quality
from transit_spark.llm.scratch import keep


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are. Every text has a score, a null or empty one that of a text without words;
    repeated rows are kept or dropped alike; an empty table gives none; other columns pass through, whatever their names."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that many sources share; n_chars is that of the new text. Null and empty texts stay as they are; of a document's
    repeated rows each loses the same lines; a document is never dropped, however long; an empty table gives none."""
    kept = lines.drop_boilerplate(docs)
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id, as it is. Null, empty and blank texts are no copies of anything, but of
    rows with the same doc_id and text one stays; an empty table gives none; other columns pass through, whatever their names."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, as they are. Null and empty texts have none and stay; whole texts are scanned, however long; repeated
    rows are kept or dropped alike; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null or empty text is one token, the end; repeated rows are packed each; long texts are
    cut into pieces; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The classifier's scores and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
