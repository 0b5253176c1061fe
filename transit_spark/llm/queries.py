"""The registered queries of the operators in this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.llm import ann, decontam, langid, lexical, licenses, lines, negatives, ngram_join, packing, quality, sharding, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), only_copies=False)
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(key % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows, key % 100 == 0)


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_warc_normaliser, op2_embedding_graph, op3_quality_discriminant, op4_license_search, op5_hypergeometric_shards,
    op6_aho_corasick_decontamination, op7_ngram_jaccard, op8_hyperdimensional_language, op9_minimum_bin_slack, op10_line_spread,
    op11_threshold_negatives, op12_learned_partitions, op13_dual_tree_search,
)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of decontamination, in DuckDB: the lowered text with all but words made blank.
PLAIN_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_warc_normaliser": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)""",
    "op2_embedding_graph": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op6_aho_corasick_decontamination": rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 8), lambda j: array_to_string(ws[j:j + 9], ' ')) END) AS s FROM i),
d AS (SELECT doc_id, {PLAIN_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
hit AS (SELECT pos.doc_id, pos.p, pos.k, win.item FROM pos JOIN win ON pos.s = win.s AND pos.k = win.k),
words AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS w FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.list, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  WHERE a.s IN (SELECT s FROM rare) GROUP BY 1, 2),
links AS (SELECT i.a, i.b FROM inter i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.i >= 80 * (x.n + y.n - i.i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op10_line_spread": """
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, coalesce(source, '') AS source, unnest(range(1, len(ls) + 1)) AS pos, unnest(list_transform(ls, lambda y: trim(y, ' ' || chr(9) || chr(13)))) AS line FROM l),
spread AS (SELECT line, min(doc_id) AS first FROM x WHERE length(line) >= 10 GROUP BY line HAVING count(DISTINCT source) >= 3),
hit AS (SELECT x.doc_id, list(x.pos) AS gone, sum(length(x.line)) AS n FROM x JOIN spread s ON s.line = x.line AND x.doc_id <> s.first GROUP BY x.doc_id),
j AS (SELECT l.doc_id, l.text, l.ls, hit.gone, hit.gone IS NOT NULL AND hit.n <= 0.5 * length(l.text) AS go FROM l LEFT JOIN hit USING (doc_id))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN go THEN len(gone) ELSE 0 END AS BIGINT) AS n_removed,
  sha256(CASE WHEN go THEN array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) ELSE coalesce(text, '') END) AS text_sha256
FROM j""",
    "op11_threshold_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5""",
    "op13_dual_tree_search": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY t, docs),
x AS (SELECT tf.doc_id, tf.t, (1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * d.n * docs) // words)) AS impact FROM tf JOIN d USING (doc_id), tot),
s AS (SELECT i.item_id, x.doc_id, CAST(sum(df.w * x.impact) AS BIGINT) AS score FROM i JOIN df USING (t) JOIN x USING (t) GROUP BY i.item_id, x.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
