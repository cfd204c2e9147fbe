"""Joins that give a row a document instead of its pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("pyspark")
from pyspark.sql import functions as F

from cairn.llm import jaccard_join, metric_join
from cairn.llm.graph import components
from cairn.llm.queries import LLM_QUERIES, LLM_SQL
from tests import test_queries as engine
from tests.llm.test_operators import awkward, corpus, documents, empty, shingles, vocabulary


def classes(keys, links):
    """Least key that links lead to, and number of links, of each key."""
    least, n = {k: k for k in keys}, dict.fromkeys(keys, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        least = {k: min(least[a], least[b]) if v in (least[a], least[b]) else v for k, v in least.items()}
    return least, n


def brute_classes(rows, threshold, n):
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingles(t, n) if t else set() for _, t in docs]
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12]
    least, count = classes(range(len(docs)), links)
    return sorted((docs[k][0], docs[least[k]][0], count[k]) for k in range(len(docs))), links


def found(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


@pytest.mark.parametrize(("threshold", "n", "hot", "block"), [(0.4, 4, 64, 4096), (0.3, 2, 3, 5), (0.8, 3, 1, 2)])
def test_classes_and_links_agree_with_brute_force(spark, monkeypatch, threshold, n, hot, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = list(enumerate(corpus()))
    # repeated rows, two texts of an id, and a text without an id that would link two others
    a, b, c = (" ".join(vocabulary(90, 9)[i : i + 40]) for i in (0, 14, 28))
    rows += [rows[4], rows[4], (3, rows[8][1]), (900, a), (None, b), (901, c), (902, a + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, links = brute_classes(rows, threshold, n)
    assert links and found(jaccard_join.jaccard_classes(df, n, threshold)) == want


def test_the_join_gives_a_row_a_document(spark, tmp_path):
    r, v = random.Random(2), vocabulary(300)
    base = r.choices(v, k=80)
    texts = [" ".join(base)] * 40
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(80)] = r.choice(v)
        texts.append(" ".join(w))
    texts.append("apart from all others")
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op3_jaccard_join"](spark, str(tmp_path))
    assert got.count() == len(texts)
    assert found(got) == brute_classes(list(enumerate(texts)), jaccard_join.THRESHOLD, jaccard_join.N)[0]
    assert engine.canonical(got.columns, [tuple(x) for x in got.collect()]) == engine.oracle(LLM_SQL["op3_jaccard_join"], str(tmp_path))


def test_classes_on_awkward_input(spark):
    assert found(jaccard_join.jaccard_classes(awkward(spark))) == [(i, i, 0) for i in range(1, 6)]
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0


def brute_vectors(rows, cosine):
    """Distinct id and vector, the usable ones against each other."""
    docs = sorted(set(rows), key=repr)
    docs.sort(key=lambda x: x[0])
    links = []
    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = (np.array(docs[k][1] or [0.0], float) for k in (a, b))
        if len(x) == len(y) and x.any() and y.any() and round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9) >= cosine:
            links.append((a, b))
    least, count = classes(range(len(docs)), links)
    return sorted((docs[k][0], docs[least[k]][0], count[k]) for k in range(len(docs))), links


def found_vectors(df):
    return sorted((r.vec_id, r.class_id, r.n_links) for r in df.collect())


def test_vector_classes_agree_with_brute_force(spark, monkeypatch, tmp_path):
    for name, value in (("PER_PIVOT", 2.0), ("PART", 30), ("MEMBERS", 50)):
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 12))
    x = np.concatenate([base, base[:60] + 0.08 * rng.normal(size=(60, 12)), base[:60] + 0.15 * rng.normal(size=(60, 12)), base[:5], 3 * base[5:8], np.tile(base[9], (40, 1))])
    rows = [(i, tuple(float(y) for y in v)) for i, v in enumerate(x)]
    want, links = brute_vectors(rows, metric_join.COSINE)
    spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = LLM_QUERIES["op5_metric_join"](spark, str(tmp_path))
    assert len(links) > 800 and got.count() == len(rows) and found_vectors(got) == want
    assert engine.canonical(got.columns, [tuple(r) for r in got.collect()]) == engine.oracle(LLM_SQL["op5_metric_join"], str(tmp_path))


def test_vector_classes_on_awkward_input(spark):
    rows = [(1, (1.0, 0.0)), (2, (1.0, 0.0)), (2, (1.0, 0.0)), (2, (2.0, 0.0)), (2, (0.0, 1.0)), (3, None), (4, ()), (5, (1.0,)), (6, (0.0, 0.0)), (7, (9.0, 0.1))]
    want, _ = brute_vectors(rows, metric_join.COSINE)
    assert (2, 2, 0) in want and (2, 1, 3) in want
    df = spark.createDataFrame([(i, None if v is None else list(v)) for i, v in [*rows, (None, (1.0, 0.0))]], "vec_id long, embedding array<float>").withColumn("ID", F.lit(0)).withColumn("v", F.lit(0))
    assert found_vectors(metric_join.near_classes(df)) == want
    odd = spark.createDataFrame([(8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert found_vectors(metric_join.near_classes(odd)) == [(8, 8, 0), (9, 9, 0), (10, 10, 0)]
    assert metric_join.near_classes(df.limit(0)).count() == 0


def test_a_licence_links_only_texts_that_may_be_similar(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    r, v = random.Random(3), vocabulary(900, 3)
    licence, texts = v[:29], []
    for i in range(20):
        body = v[100 + 26 * i : 125 + 26 * i]
        texts += [" ".join(body + licence), " ".join([*body[:-1], r.choice(v[700:])] + licence)]
    df = documents(spark, texts)
    # each text has a copy but for a word; with all others it has the 26 shingles of the licence in common, of 76
    groups = components(jaccard_join.linked(jaccard_join.sets_with_partners(df))).groupBy("component").count().collect()
    assert sorted(g["count"] for g in groups) == [2] * 20
    assert found(jaccard_join.jaccard_classes(df)) == brute_classes(list(enumerate(texts)), jaccard_join.THRESHOLD, jaccard_join.N)[0]


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.6, 0.8])
def test_chains_hold_all_that_may_be_similar(threshold):
    rng = np.random.default_rng(5)
    for _ in range(100):
        n = rng.integers(0, 40)
        shingle, size = rng.integers(0, 4, n), rng.integers(1, 40, n)
        pos = (rng.random(n) * size).astype(np.int64)
        order = np.lexsort((pos, size, shingle))
        shingle, size, pos = shingle[order], size[order], pos[order]
        keep, start = jaccard_join._chained(shingle, size, pos, threshold)
        chain = np.full(n, -1)
        chain[keep] = np.searchsorted(start, np.arange(len(keep)), "right") - 1
        assert (chain[keep] >= 0).all()
        for i, j in itertools.combinations(range(n), 2):
            if shingle[i] == shingle[j] and min(size[i] - pos[i], size[j] - pos[j]) >= jaccard_join._need(threshold, size[i], size[j]):
                assert chain[i] == chain[j] >= 0
            assert shingle[i] == shingle[j] or chain[i] != chain[j] or chain[i] < 0


@pytest.mark.parametrize(("many", "bytes_"), [(2, 48 << 20), (7, 4000), (2, 0)])
def test_answers_by_matrix_agree_with_the_sets(monkeypatch, many, bytes_):
    monkeypatch.setattr(jaccard_join, "MANY", many)
    monkeypatch.setattr(jaccard_join, "MATRIX_BYTES", bytes_)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 47, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > rng.random() * 0.6], rng.integers(0, 1 << 47, rng.integers(1, 30), dtype=np.uint64)])) for _ in range(50)]
    size = np.array([len(s) for s in sets])
    for block in (np.zeros(50, np.int64), np.arange(50) % 2):
        got = {(k, t, o) for k, to, overlap in jaccard_join._answers(sets, size, block, 0.4) for t, o in zip(to.tolist(), overlap.tolist(), strict=True)}
        shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in itertools.combinations(range(50), 2)}
        want = {(a, b, o) for (a, b), o in shared.items() if o >= 0.4 * (size[a] + size[b] - o) - 1e-9 and (not block.any() or block[a] != block[b])}
        assert want and got == want
