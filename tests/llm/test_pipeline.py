"""The pipeline: each stage on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DATA, brute_components
from transit_spark.llm import decontam, lines, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(DATA)).cache()
        assert name == "packing" or out.columns == columns
        seen.append(out)
    raw, good, cut, one, clean, packed = seen
    score = quality.score_quality(raw, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in score.where("predicted = 1").collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == {r.doc_id: r.text for r in lines.drop_boilerplate(good).collect()} and cut.where("n_chars <> length(text)").count() == 0
    groups = brute_components({r.doc_id: r.text for r in cut.collect()})
    assert {r.doc_id for r in one.collect()} == {k for k, (_, root) in groups.items() if k == root}
    hit = decontam.find_passages(one, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("n_hit = 0")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in hit.collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_of_odd_input(spark, place):
    """Nulls in every column, empty and repeated rows, extra columns with the names of columns inside, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[place]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, __k string, __text string, s1 string, node string, label string"
    text = "a plain text of a few words that nobody else has, with an end. And another sentence follows it here."
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (None, text + " x"), (5, "w " * 40_000), (6, None)]
    df = spark.createDataFrame([(i, t, None, None if i == 6 else "s", None, "k", "k", "t", "1", "n", "l") for i, t in rows], schema)
    out = stage(spark, df, str(DATA))
    found = out.collect()
    assert name == "packing" or out.columns == df.columns
    known = {(i, t) for i, t in rows}
    if name == "packing":
        assert {r.doc_id for r in found} == {i for i, _ in rows}
    else:
        assert all((r.doc_id, r.text) in known and r.s1 == "1" and r["__k"] == "k" for r in found)
    if name == "n-gram Jaccard join":
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in found) == [(1, 0), (2, 0), (3, 2), (4, len(text)), (5, 80_000), (6, 0)]
    if name in ("line dedup", "benchmark decontamination"):
        assert len(found) == len(rows)
    assert stage(spark, df.where("false"), str(DATA)).count() == 0
