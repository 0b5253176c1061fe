"""The ten operators against brute force, round trips and held-out labels; nulls, empty texts, ties and clashing names."""

import gzip
import hashlib
import itertools
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transit_spark.llm import components, decontam, langid, licenses, lines, ngram_join, packing, quality, queries, scratch, sharding, vectors, warc

DATA = Path("/root/testdata/sf0.01")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a null key, a long text, and columns whose names clash with those inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "One TWO"), (None, "nobody knows this text at all here"), (6, long), (7, long), (8, "ÄÖ ß 漢字 \U0001f600")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "c", "k") for i, t in rows], DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**{i: 0 for i in [*range(1, 51), 100]}, 201: 200}


def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (4, "u", "x"), (5, "u", "x"), (1, "http://b", big), (None, "u", big), (6, "u\r\nX: y", "<p>" * 400_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, digest string")
    found = warc.round_trip(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        raw = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_members_and_sidecar(spark):
    path = scratch.folder(spark)
    pages = spark.range(20).selectExpr("id page_id", "'u' url", "repeat(cast(id as string), 300) html")
    index = warc.normalise(warc.archive(pages, path), path)
    rows = sorted(map(tuple, index.collect()))
    assert rows == sorted(map(tuple, warc.read_index(spark, path).collect())) and len(rows) == 20
    local = path.removeprefix("file://")
    for name, offset, length, *_ in rows:
        with open(f"{local}/{name}", "rb") as f:
            f.seek(offset)
            assert gzip.decompress(f.read(length)).startswith(b"WARC/1.1\r\n")


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.05, np.repeat(base[:1], 200, axis=0) + rng.normal(size=(200, 16)) * 0.02, base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [None] * 16)]
    found = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    near = vectors.unit(x) @ vectors.unit(x).T >= 0.95
    np.fill_diagonal(near, False)
    assert sum(found[i].n_links for i in range(len(x))) >= 0.95 * near.sum() and all(found[i].n_links <= near[i].sum() for i in range(len(x)))
    reach = np.eye(len(x), dtype=bool) | near
    for _ in range(9):
        reach = reach @ reach
    assert np.mean([found[i].component_id == reach[i].argmax() for i in range(len(x))]) > 0.99
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(900, 905))
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_of_two_dense_families(spark):
    """Two families within the limit of each other, each tighter inside and larger than the candidate lists, and others."""
    rng = np.random.default_rng(11)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    centres = [axes[0], 0.97 * axes[0] + (1 - 0.97**2) ** 0.5 * axes[1]]
    families = [c + rng.normal(size=(100, 64)) * 0.005 for c in centres]
    x = np.concatenate([*families, axes[2] + rng.normal(size=(600, 64)) * 0.05]).astype(np.float32)  # the medoid is far from the families
    near = vectors.unit(x) @ vectors.unit(x).T >= 0.95
    np.fill_diagonal(near, False)
    n = 200
    assert near[:n, :n].sum() == n * (n - 1)
    found = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    assert all(r.n_links == near[r.vec_id].sum() for r in found)
    assert {r.component_id for r in found if r.vec_id < n} == {0}


def test_vectors_in_double_precision(spark):
    """Components beyond a float's range, and cosines that only doubles tell from the limit."""
    e = 0.95
    rows = [(1, [1e200, 1.0]), (2, [1e200, 1.0]), (3, [0.0, 0.0, 1.0][:2]), (4, [1e-300, 2e-300]), (5, [1.0, 2.0]), (10, [0.0, -1.0]), (11, [-((1 - e * e) ** 0.5) * (1 + 1e-9), -e])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 10: (0, 10), 11: (0, 11)}


@pytest.mark.parametrize("many", [4000, 40])
def test_vectors_of_every_length(spark, monkeypatch, many):
    """Lengths are searched each, the rare ones too; a crowd of one vector is dealt to several tasks; the recall is told."""
    monkeypatch.setattr(vectors, "MANY", many)
    monkeypatch.setattr(vectors, "HOT", 20)
    rng = np.random.default_rng(6)
    rows, key = [], 0
    for d, n in ((3, 120), (5, 60), (2, 7), (1, 2)):
        base = rng.normal(size=(n // 2 + 1, d))
        for v in [*base, *(base[: n // 2] + 0.01 * rng.normal(size=(n // 2, d)))]:
            rows.append((key, [float(np.float32(x)) for x in v], 1, "k"))
            key += 1
    rows += [(1000 + i, [1.0, 1.0], 1, "k") for i in range(30)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x int, key string")).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    links = {i: {j for j, b, *_ in rows if j != i and len(b) == len(a) and cos(a, b) >= 0.95} for i, a, *_ in rows}
    assert {r.vec_id: r.n_links for r in got} == {i: len(v) for i, v in links.items()}
    assert len({r.recall for r in got}) == 1 and got[0].recall == 1.0
    lone = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.recall) for r in lone} == {(1, 0, None), (2, 0, None)}


def test_vectors_audit_sees_small_families(spark):
    """Of one large family and many pairs, all pairs lost: the recall tells."""
    rng = np.random.default_rng(3)
    rows = [(i, 1, (np.eye(64)[0] + rng.normal(size=64) * 0.01).tolist()) for i in range(60)]
    for p in range(60):
        v = rng.normal(size=64)
        rows += [(100 + 2 * p, 1, v.tolist()), (101 + 2 * p, 1, (v + rng.normal(size=64) * 0.01).tolist())]
    nodes = spark.createDataFrame(rows, "node bigint, size bigint, x array<double>")
    large = spark.createDataFrame([(i, 59) for i in range(60)], "node bigint, links bigint")
    assert vectors.audit(nodes, large, 0.95) == pytest.approx(60 / 180)


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93 and np.mean([r.predicted for r in held if r.quality]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_against_dense_algebra(spark, docs):
    """Scores from whole matrices with solve and slogdet, without moments, factors or Spark."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality in (0, 1)}
    rows = docs.select("doc_id", "text").toArrow().combine_chunks()
    ids, x = rows.column("doc_id").to_pylist(), quality.statistics(rows.column("text").combine_chunks())
    known = np.array([i in labels and zlib.crc32(str(i).encode()) % 5 != 0 for i in ids])
    y = np.array([labels.get(i, -1) for i in ids])
    centre = x[known].mean(axis=0)
    share = np.expm1(x[:, :1]) / (np.expm1(x[:, :1]) + 8)
    z = centre + (x - centre) * share
    k, shrink, log = x.shape[1], 0.02, {}
    parts = {c: z[known & (y == c)] for c in (0, 1)}
    scatter = {c: (p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) for c, p in parts.items()}
    pooled = sum(scatter.values()) / (known.sum() - 2) + 1e-3 * np.eye(k)
    for c, p in parts.items():
        own, w = scatter[c] / (len(p) - 1) + 1e-3 * np.eye(k), len(p) / (len(p) + 10 * k)
        own = (1 - shrink) * (w * own + (1 - w) * pooled) + shrink * pooled
        own = (1 - shrink) * own + shrink * np.trace(own) / k * np.eye(k)
        d = z - p.mean(axis=0)
        log[c] = np.log(len(p) / known.sum()) - 0.5 * (np.linalg.slogdet(own)[1] + (d * np.linalg.solve(own, d.T).T).sum(axis=1))
    expected = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    found = {r.doc_id: r.score for r in quality.score_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert max(abs(found[i] - e) for i, e in zip(ids, expected, strict=True)) < 1e-6


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_licenses(spark, odd, none):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for i, (notice, label) in enumerate(licenses.NOTICES.items()):
        for edits in range(6):
            text = list(notice)
            for at in rng.choice(len(text), edits, replace=False):
                text[at] = "q"
            rows.append((i * 10 + edits, f"word word. {''.join(text)} and more"))
            near = {lab for n, lab in licenses.NOTICES.items() if any(_edits(n, "".join(text)[a:b]) <= max(1, len(n) // licenses.CHARACTERS_AN_EDIT) for a in (0,) for b in range(max(1, len(text) - 6), len(text) + 1))}
            expected[i * 10 + edits] = (label, edits <= max(1, len(notice) // licenses.CHARACTERS_AN_EDIT), near)
    found = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, (label, hit, near) in expected.items():
        said = set(found[k].labels.split(",")) - {"", *licenses.PHRASES.values()}
        assert near <= said, (rows[k // 10 * 6 + k % 10], near, said)
        if hit:
            assert label in said and found[k].score > 0
        for span in found[k].spans:
            text = rows[k // 10 * 6 + k % 10][1]
            notices = [n for n, x in licenses.NOTICES.items() if x == span.label]
            assert any(_edits(n, text[span.start + i : span.stop - j]) <= max(1, len(n) // licenses.CHARACTERS_AN_EDIT) for n in notices for i in range(6) for j in range(6)), (span, text)
    two = spark.createDataFrame([(1, "licensed undr cc by nc 4 0 foo licensed under cc by nc 4 0")], "doc_id bigint, text string")
    assert [(s.label, s.start, s.stop, s.edits) for s in licenses.find_licenses(two).first().spans if s.label == "notice-cc-by-nc"] == [("notice-cc-by-nc", 0, 26, 1), ("notice-cc-by-nc", 31, 58, 0)]
    base = spark.createDataFrame([(1, "All rights-reserved; CC BY cc by 4, general public license"), (2, "cc bye"), (3, None)], "doc_id bigint, text string")
    r = {x.doc_id: x for x in licenses.find_licenses(base).collect()}
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (11, 4, 0, 8, "cc-by,gpl,reserved")
    assert (r[2].n_base, r[2].first_word, r[2].base_labels, r[3].n_words, r[3].score) == (0, None, "", 0, 0.0)
    assert licenses.find_licenses(odd).count() == 10 and licenses.find_licenses(none).count() == 0


def test_licenses_against_brute_force(docs, texts):
    for r in licenses.find_licenses(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(texts[r.doc_id]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_sharding(spark, docs, odd, none):
    rows = sharding.shuffle(docs).collect()
    sizes = Counter(r["__shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    assert all(sorted(r["__slot"] for r in rows if r["__shard"] == k) == list(range(n)) for k, n in sizes.items())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert sharding.shuffle(odd).count() == 10 and sharding.shuffle(none).count() == 0
    clash = odd.withColumnsRenamed({"cls": "__block", "key": "__row", "source": "__shard"})
    out = sharding.shuffle(clash)
    assert sorted(out.columns) == sorted({*clash.columns, "__slot"}) and {(r["__block"], r["__row"]) for r in out.collect()} == {("c", "k")}


def test_sharding_query(spark, texts):
    """The query's columns from each text itself; slots and shards as the law says."""
    rows = queries.op5_hypergeometric_shards(spark, str(DATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_hypergeometric_is_uniform():
    rng = np.random.default_rng(3)
    draws = [sharding.hypergeometric(rng, 12, 20, 9) for _ in range(20_000)]
    assert abs(np.mean(draws) - 9 * 12 / 32) < 0.03 and abs(np.var(draws) - 9 * (12 / 32) * (20 / 32) * 23 / 31) < 0.06
    out = sharding.matrix([10**11, 5, 0], [5 * 10**10, 5 * 10**10 + 5], rng)
    assert out.sum(axis=1).tolist() == [10**11, 5, 0] and out.sum(axis=0).tolist() == [5 * 10**10, 5 * 10**10 + 5]


def test_decontamination(spark, docs, texts, odd, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    owners = {}
    for r in bench.collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            owners.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    for r in decontam.find_passages(docs, bench).collect():
        w, hit, items = words(texts[r.doc_id]), set(), set()
        for k in {len(x) for x in owners}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in owners:
                    hit.update(range(i, i + k))
                    items |= owners[tuple(w[i : i + k])]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(items))
        raw = (texts[r.doc_id] or "").encode()
        assert sum(len(words(raw[s.start : s.stop].decode())) for s in r.spans) == len(hit)
    assert decontam.find_passages(odd, bench).where("n_hit > 0").count() == 0 and decontam.find_passages(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench).collect() == odd.collect()
    assert decontam.find_passages(odd, bench.where("false")).count() == 10


def test_decontamination_in_parts(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = {r.doc_id: (r.n_hit, r["items"], r.spans) for r in decontam.find_passages(docs, bench).collect()}
    monkeypatch.setattr(decontam, "AUTOMATON_NODES", 8000)
    assert {r.doc_id: (r.n_hit, r["items"], r.spans) for r in decontam.find_passages(docs, bench).collect()} == whole


def brute_components(texts, width=5, percent=80):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_ngram_join(spark, docs, texts, odd, none):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == brute_components(texts)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd).collect()}
    assert {x for x in found if x[0] in (1, 2, 3, 4, 5)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4)} and (6, 29996, 6) in found and (7, 29996, 6) in found
    assert ngram_join.near_duplicates(none).count() == 0
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(odd).collect()) == [0, 1, 2, 3, 4, 6, 8]
    rows = [(0, "u v w x y z"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "k l m n o p"), (2, "K l m n o p"), (3, None), (3, ""), (3, "")]
    stay = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, stay_key int, Stay_text int, _stay int")
    assert Counter(tuple(r)[:2] for r in ngram_join.one_of_each(clash).collect()) == Counter(tuple(r) for r in stay)
    assert sorted((r.doc_id, (r.text or "-").lower()) for r in stay) == [(0, "u v w x y z"), (1, "a b c d e f"), (2, "k l m n o p"), (3, "-"), (3, "-")]


def test_ngram_join_near_the_limit(spark):
    rng = np.random.default_rng(8)
    rows = {}
    for family in range(25):
        size = int(rng.integers(5, 120))
        base = [f"f{family}w{i}" for i in range(size)]
        for copy in range(12):
            text = list(base)
            for at in rng.choice(size, int(rng.integers(0, max(2, size // 20))), replace=False):
                text[at] = f"e{rng.integers(1 << 30)}"
            rows[family * 100 + copy] = " ".join(text)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == brute_components(rows)


def test_ngram_join_spares_hold_for_every_pair():
    """Any differing words up to the bound leave more common keys than either set leaves out."""
    low, triples = ngram_join.bands(80)
    for n in [*range(1, 400), 1000, 4321]:
        for m in range(n, n * 100 // 80 + 1):
            t = 20 * (n + m) // 180
            if t == 0:
                continue
            own = [np.array([x]) for x in (n, m)]
            (band, many, mine), _ = ngram_join.spares(own[0], 80)
            (other, _, theirs), (under, many2, below) = ngram_join.spares(own[1], 80)
            assert other[0] == band[0] or (under[0] == band[0] and many2[0] == many[0])
            spare = max(mine[0], theirs[0] if other[0] == band[0] else below[0])
            common = 3 * many[0] - 2 * t if t <= many[0] else 2 * many[0] - t
            assert common > spare > 0


def test_ngram_join_sends_eight_bytes_a_key(spark, monkeypatch):
    """An entry is 64 bits; and with so few bits of a key that most sets have some of their own in common, no link is lost."""
    from transit_spark.llm import ngram_join

    assert ngram_join.ENTRY.itemsize <= 8
    rng = np.random.default_rng(5)
    rows = []
    for f in range(60):
        base = rng.integers(0, 10**6, 200)
        for k in range(3):
            own = base.copy()
            own[:: 50 + k] += k
            rows.append((3 * f + k, " ".join(map(str, own))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r[0]: r[2] for r in ngram_join.near_duplicates(docs).collect()}
    assert len(set(want.values())) < len(want)
    monkeypatch.setattr(ngram_join, "CLASS_BITS", 47)
    monkeypatch.setattr(ngram_join, "OWNER_BITS", 48)
    assert {r[0]: r[2] for r in ngram_join.near_duplicates(docs).collect()} == want


def test_ngram_join_of_a_crowd_near_the_limit(spark):
    """Many texts of one group, some similar and some just not, joined by few links."""
    rng = np.random.default_rng(21)
    base = [f"b{i}" for i in range(150)]
    rows = {}
    for i in range(160):
        text = list(base)
        for at in rng.choice(150, int(rng.integers(1, 5)), replace=False):
            text[at] = f"e{i}x{at}"
        rows[i] = " ".join(text)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == brute_components(rows)


def test_ngram_join_sends_a_text_once_for_all_of_its_groups(spark, monkeypatch):
    """Texts of a crowd share keys in many different sets; those that stay apart meet once in the last round."""
    rng = np.random.default_rng(22)
    rows = {}
    for family in range(3):
        for i in range(40):
            text = [f"f{family}b{k}" for k in range(150)]
            for at in rng.choice(150, int(rng.integers(3, 6)), replace=False):
                text[at] = f"e{family}x{i}x{at}"
            rows[100 * family + i] = " ".join(text)
    sent, joining = [], ngram_join._joining

    def counted(*args):
        sent.append((args[6].count(), args[6].select("node").distinct().count()))
        return joining(*args)

    monkeypatch.setattr(ngram_join, "_joining", counted)
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == brute_components(rows)
    assert sent and all(many == nodes > 0 for many, nodes in sent)


def test_ngram_join_families(spark, monkeypatch):
    """Groups with members in common are one, those without are not; a family of more blocks than its groups need stays in groups."""
    near = [(1, 1, n) for n in (1, 2, 3)] + [(2, 2, n) for n in (2, 3, 4)] + [(3, 8, n) for n in (8, 9)]
    near = spark.createDataFrame(near, "gid bigint, hub bigint, node bigint")
    facts = spark.createDataFrame([(n, 10, b"") for n in range(12)], "node bigint, n bigint, sketch binary")
    found = {}
    for r in ngram_join._families(near, facts).collect():
        found.setdefault(r.gid, []).append(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4], [8, 9]]
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    chain = spark.createDataFrame([(g, g, n) for g in range(9) for n in (g, g + 1)], "gid bigint, hub bigint, node bigint")
    assert {(r.gid, r.node) for r in ngram_join._families(chain, facts).collect()} == {(g, n) for g in range(9) for n in (g, g + 1)}


def test_language_held_out(docs, odd, none):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[4] == "en"
    assert langid.identify(none).count() == 0


def test_language_vectors_against_loops():
    """The profile of a text, letter by letter; short texts and many scripts in one batch."""
    texts = ["Der Zug, der fährt.", "", "a", "12 34", None, "漢字 かな", "x" * 500]

    def profile(text):
        out = np.zeros(langid.DIMENSIONS)
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            for i in range(1, len(padded) - 1):
                a, b, c = (langid.letter_vector(ord(x)).astype(float) for x in padded[i - 1 : i + 2])
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out

    found, any_letter = langid.profiles(pa.array(texts, pa.string()))
    assert np.array_equal(found, np.array([profile(t) for t in texts])) and any_letter.tolist() == [True, False, True, False, False, True, True]


def test_packing(spark, docs, texts, odd, none):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, ids=True).collect()
    parts, windows = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        parts.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, bytes(r.ids)))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, text in texts.items():
        ids = np.frombuffer(b"".join(x[3] for x in sorted(parts[k])), "<u4").tolist()
        assert ids == [*tokens.encode(text or "", add_special_tokens=False).ids, 0] and {x[2] for x in parts[k]} == {len(ids)}
    padding = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sorted(windows) == list(range(len(windows))) and padding < 0.01 * 1024 * len(windows)
    assert packing.pack(none).count() == 0 and packing.pack(odd).where("doc_id <= 2").select("length").distinct().first().length == 1


def test_packing_of_added_tokens(spark):
    """The tokenizers file matches its added token in texts, also at their ends, twice in a row and in a long text."""
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>x", "<|endoftext|", "no token", "some words <|endoftext|> " * 700]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ids=True).orderBy("doc_id", "start").collect()
    for i, text in enumerate(texts):
        ids = np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == i), "<u4").tolist()
        assert ids == [*tokens.encode(text, add_special_tokens=False).ids, 0] and {r.doc_tokens for r in rows if r.doc_id == i} == {len(ids)}
    assert [r.ids for r in rows if r.doc_id == 0] == [np.array([64, 50256, 65, 0], "<u4").tobytes()]


def test_fill_is_closest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = Counter(int(x) for x in rng.integers(1, 30, 8))
        used = packing.fill(dict(counts), 64)
        longest = max(counts)
        rest = list((counts - Counter([longest])).elements())
        best = max((longest + s for s in {sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n)} if longest + s <= 64))
        assert sum(k * v for k, v in used.items()) == best and all(v <= counts[k] for k, v in used.items())


def test_lines_of_mostly_shared_text(spark):
    """A page that is mostly shared lines loses them unless it is a copy of another document."""
    nav = ["Home | About | Contact | Sitemap of this site", "All of the opening hours and holidays are on the notice board"]
    rows = [(i, "\n".join([*nav, f"own text {i} is short"]), f"s{i}") for i in range(4)]
    rows += [(10, "\n".join(nav), "s1"), (11, "\n".join(nav), "s2"), (12, nav[0], "s3"), (13, "\n".join([*nav, "own text 13 is short", "x"]), "s3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: (r["__n_removed"], r.text) for r in lines.drop_boilerplate(df).collect()}
    assert out == {0: (0, rows[0][1]), **{i: (2, f"own text {i} is short") for i in (1, 2, 3)}, 10: (0, rows[4][1]), 11: (0, rows[5][1]), 12: (1, ""), 13: (2, "own text 13 is short\nx")}


def test_lines(spark, odd, none):
    shared = "This line is on every site there is."
    rows = [(i, f"own text number {i} with a few words more than that\n{shared} \nlast line of {i} is its own again", f"s{i % 4}") for i in range(8)]
    rows += [(20 + i, "A copy that is whole on three sites.\nIts second line is as well.", f"s{i}") for i in range(3)] + [(30, None, "s1"), (31, "", None), (7, rows[7][1], "s3")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id bigint, text string, source string, __h string")
    out = lines.drop_boilerplate(df.drop("__h")).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        gone = 1 <= r.doc_id <= 7
        assert (r["__n_removed"], r.text) == (int(gone), text.replace(f"\n{shared} ", "") if gone else text)
    clash = [f"__{x}" for x in ("k", "t", "gone", "hit", "copy", "text", "new", "key", "h")]
    named = df.select("doc_id", "text", "source", *[F.lit(c).alias(c) for c in clash], F.lit("mine").alias("__n_lines"))
    again = lines.drop_boilerplate(named).collect()
    assert {(r.doc_id, r.text, r["__n_removed"]) for r in again} == {(r.doc_id, r.text, r["__n_removed"]) for r in out} and all([r[c] for c in [*clash, "__n_lines"]] == [*clash, "mine"] for r in again)
    assert {r.doc_id: r["__n_lines"] for r in out}[31] == 1 and lines.drop_boilerplate(none).count() == 0 and lines.drop_boilerplate(odd).count() == 10
