"""The pipeline against a brute-force version, and every query of the corpus operators against its SQL."""

from __future__ import annotations

import hashlib
import importlib.util
from pathlib import Path

import pytest

import corpus_pipeline
from cairn.llm import bpe_reuse, jaccard_join, mixing, quality_rules, substring_dedup
from cairn.llm.queries import LLM_QUERIES, LLM_SQL

HERE = Path(__file__).parent
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _module(path, name):
    spec = importlib.util.spec_from_file_location(name, path)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


brute = _module(HERE / "test_operators.py", "brute")
engine = _module(HERE.parent / "test_queries.py", "engine_queries")


def verdicts(rows):
    """Of ``doc_id, text, source``: which rows the host-level rules keep."""
    marks = [brute.brute_marks(t) for _, t, _ in rows]
    bad = set()
    hosts = {s for _, _, s in rows}
    for r in quality_rules.RULES:
        n = {h: sum(s == h for _, _, s in rows) for h in hosts}
        f = {h: sum(s == h and r in m[0] for (_, _, s), m in zip(rows, marks, strict=True)) for h in hosts}
        mean = sum(f.values()) / len(rows)
        spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in hosts) / len(rows) - mean * (1 - mean) * len(hosts) / len(rows)
        k = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1), 1000)
        limit = max(mean + quality_rules.Z * (mean * (1 - mean) / (k + 1)) ** 0.5, quality_rules.LEAST)
        bad |= {(h, r) for h in hosts if (f[h] + mean * k) / (n[h] + k) > limit}
    return [not hard and not any((s, r) in bad for r in soft) for (_, _, s), (soft, hard) in zip(rows, marks, strict=True)]


def by_hand(rows):
    """All stages over ``doc_id, text, source`` in plain Python."""
    kept = [r for r, ok in zip(rows, verdicts(rows), strict=True) if ok]
    group = {i: i for i, _, _ in kept}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b, _ in brute.brute_pairs([(i, t) for i, t, _ in kept], jaccard_join.THRESHOLD):
        group[max(find(a), find(b))] = min(find(a), find(b))
    kept = [r for r in kept if find(r[0]) == r[0]]
    texts = dict(brute.brute_cut([(i, t) for i, t, _ in kept], substring_dedup.K))
    kept = [(i, texts[i], s) for i, _, s in kept]
    size = {}
    for _, t, s in kept:
        size[s] = size.get(s, 0) + len(t)
    size = {s: n for s, n in size.items() if n}
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    full, budget = {}, sum(size.values())
    while True:
        rest, w = budget - sum(full.values()), sum(weight[s] for s in weight if s not in full)
        over = [s for s in weight if s not in full and weight[s] * rest / w > mixing.MAX_EPOCHS * size[s]]
        if not over:
            break
        full |= {s: mixing.MAX_EPOCHS * size[s] for s in over}
    enc, _ = bpe_reuse.encoding()
    out = []
    for i, t, s in kept:
        if s not in size:
            continue
        e = full.get(s, weight[s] * rest / w) / size[s]
        key = f"{mixing.SEED}:{i}:{hashlib.md5(t.encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, s, tuple(enc.encode_ordinary(t)))] * (int(e) + (u < e - int(e)))
    return sorted(out)


@needs_tables
def test_pipeline_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.source, tuple(r.tokens)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == by_hand(rows)


def test_a_bad_host_loses_documents_in_the_pipeline(spark):
    soft, good = "the cat cat sat sat on on the mat mat and slept", "A plain sentence of several ordinary words stands here."
    rows = [(i, f"{soft} {i}", "bad") for i in range(60)] + [(60 + i, f"{good} {i}", f"h{i % 12}") for i in range(240)] + [(500, soft, "h1"), (501, good, "bad")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], brute.DOCS)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, df, SF).collect()}
    assert kept == {i for (i, _, _), ok in zip(rows, verdicts(rows), strict=True) if ok} == set(range(60, 300)) | {500, 501}


def test_stages_take_awkward_and_empty_tables(spark):
    for make in (brute.awkward, brute.empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "encode" or out.columns == docs.columns
            got = [tuple(r) for r in out.collect()]  # every column is made
            if name in ("repeats", "encode"):
                assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in docs.collect())
            elif name != "mix":
                assert set(map(str, got)) <= {str(tuple(r)) for r in docs.collect()}


@needs_tables
@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_agrees_with_sql(spark, name):
    df = LLM_QUERIES[name](spark, SF)
    assert engine.canonical(df.columns, [tuple(r) for r in df.collect()]) == engine.oracle(LLM_SQL[name], SF)


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 11)) and "pipeline" in LLM_QUERIES and len(corpus_pipeline.STAGES) == 5
