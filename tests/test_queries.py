"""Every query of the engine against its SQL twin, on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import numpy as np
import pytest

from cairn.plans.queries import QUERIES, SQL

SF = os.environ.get("CAIRN_TEST_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(plain, v)) + "]"
        try:
            return f"{float(v) + 0.0:.6f}" if v is not None and not isinstance(v, (str, bool)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sql, sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    r = con.execute(sql)
    return canonical([d[0] for d in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == oracle(SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_ends_as_a_batch_would(spark):
    got = {r.file_path: r.modified for r in QUERIES["incremental_stream"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200 and (doc_id % 2 = 0 or doc_id % 3 = 0)").collect()
    day = 86400
    assert got == {f"{d.source}/{d.doc_id}": 1704067200 + (day if d.doc_id % 3 == 0 else 0) for d in docs}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def embedding_table(path, vectors, labels):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(t, str(path / "embeddings.parquet"), row_group_size=101)


@pytest.mark.parametrize("name", ["search_coalesced", "search_filtered_pool", "search_glob", "search_min_lines", "cosine_topk", "search_multi_query_topk", "match_list_tokens"])
def test_copies_of_vectors_agree_with_sql(spark, name, tmp_path):
    """A vector's copies are at one distance, never below 0, and go by id."""
    own = np.random.default_rng(3).normal(size=(41, 64)).astype(np.float32)
    embedding_table(tmp_path, np.concatenate([own] * 9), [i % 41 % 10 for i in range(41 * 9)])
    df = QUERIES[name](spark, str(tmp_path))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == oracle(SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", ["search_coalesced", "search_filtered_pool"])
def test_files_on_the_far_side_go_by_distance(spark, name, tmp_path):
    """Scores below 0 are shown as 0, but files go by what they were, as in SQL."""
    rng = np.random.default_rng(7)
    q = rng.normal(size=64)
    away = [-q + s * rng.normal(size=64) for s in np.linspace(1.0, 0.1, 24)]
    embedding_table(tmp_path, np.asarray([q, *away], np.float32), [0, *(30 - i for i in range(24))])
    df = QUERIES[name](spark, str(tmp_path))
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == oracle(SQL[name], str(tmp_path))
