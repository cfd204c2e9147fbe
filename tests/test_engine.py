from __future__ import annotations

import json
import subprocess
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import embedders
from cairn.functions.vectors import batch_distances
from cairn.operators import evaluate as ev
from cairn.operators import maintain as mt
from cairn.operators import search as se
from cairn.operators.render import as_json, as_text, match_tokens, profile_line
from cairn.schema import AllFailed, AlreadyExists, AmbiguousFolder, BadName, Busy, DimensionMismatch, NoSuchStore, ProfileMismatch, ProfileNotRecorded
from cairn.sources.files import one_file, page_chunks, register_reader, scan, texts
from cairn.sources.paths import Files
from cairn.store import VectorStore, append_log

# search


def hits(spark, rows):
    return spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(rows)], "id long, file_path string, distance double")


@pytest.mark.parametrize(
    ("rows", "limit", "want"),
    [
        ([("a", 0.2)], 10, [("a", 0.8, [0.2])]),
        ([("a", 0.3), ("a", 0.1), ("a", 0.5)], 10, [("a", 0.9, [0.1, 0.3, 0.5])]),
        ([("c", 0.8), ("a", 0.1), ("b", 0.4)], 10, [("a", 0.9, [0.1]), ("b", 0.6, [0.4]), ("c", 0.2, [0.8])]),
        ([(c, 0.1 * (i + 1)) for i, c in enumerate("abcde")], 3, [("a", 0.9, [0.1]), ("b", 0.8, [0.2]), ("c", 0.7, [0.3])]),
        ([("a", 1.5)], 10, [("a", 0.0, [1.5])]),
        ([("views", 0.3), ("models", 0.1), ("tests", 0.2), ("views", 0.6), ("models", 0.4)], 10, [("models", 0.9, [0.1, 0.4]), ("tests", 0.8, [0.2]), ("views", 0.7, [0.3, 0.6])]),
        ([("a", 0.0)], 10, [("a", 1.0, [0.0])]),
        ([("a", 0.0)], 0, []),
        ([], 5, []),
    ],
)
def test_coalescing(spark, rows, limit, want):
    got = [(r.file_path, pytest.approx(r.best_score), [m.distance for m in r.matches]) for r in se.coalesced(hits(spark, rows), limit).collect()]
    assert [(p, s.expected if hasattr(s, "expected") else s, pytest.approx(d)) for p, s, d in got] == [(p, pytest.approx(s), d) for p, s, d in want]


def chunk_table(spark, n=40, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, f"dir/f{i % 7}.{'md' if i % 2 else 'txt'}", [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, file_path string, embedding array<float>").repartition(3)


def test_top_k_is_exact_with_ties_by_id(spark):
    rows, df = chunk_table(spark)
    rows += [(100 + i, "dir/tie.md", rows[5][2]) for i in range(4)]
    df = spark.createDataFrame(rows, df.schema).repartition(5)
    q = {i: rows[i][2] for i in (5, 9)}
    m = np.array([r[2] for r in rows])
    for r_q, v in q.items():
        d = 1 - m @ np.array(v) / (np.linalg.norm(m, axis=1) * np.linalg.norm(v))
        want = [rows[i][0] for i in sorted(range(len(rows)), key=lambda i: (round(d[i], 6), rows[i][0]))][:8]
        got = [x.id for x in se.top_k(df, q, 8).where(F.col("query_id") == r_q).orderBy("rank").collect()]
        assert set(got) == set(want)


def test_rows_without_vector_are_left_out(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", None), (3, "c", []), (4, "d", [1.0])], "id long, file_path string, embedding array<float>")
    assert {r.id: r.distance for r in se.distances(df, {0: [1.0, 0.0]}).collect()} == {1: 0.0, 4: 1.0}
    with pytest.raises(DimensionMismatch):
        se.distances(df, {0: [1.0], 1: [1.0, 2.0]})


def test_distances_are_sums_in_order():
    rng = np.random.default_rng(2)
    for v in rng.normal(size=(40, 64)).astype(np.float32):
        for n in (1, 2, 7, 10):
            at, d = batch_distances(pa.array([v.tolist()] * n, pa.list_(pa.float32())), v.astype(float)[None])
            assert list(at) == list(range(n)) and not np.any(d) and not np.any(np.signbit(d))
    tiny = np.array([[3e-150, 4e-150]])
    assert batch_distances(pa.array([[6e-150, 8e-150], [0.0, 0.0]]), tiny)[1].tolist() == [[pytest.approx(0)], [1.0]]


def test_pool_rule_and_filters(spark):
    rows, df = chunk_table(spark)
    meta = spark.createDataFrame([(f"dir/f{i}.md", 10 * i if i else None) for i in range(7)], "file_path string, line_page_count long")
    q = rows[0][2]
    assert se.search(df, q, 2).count() <= 2
    assert sum(len(r.matches) for r in se.search(df, q, 2).collect()) <= 6
    assert sum(len(r.matches) for r in se.search(df, q, 100, glob="*").collect()) == 40
    assert {r.file_path for r in se.search(df, q, 100, glob="f[0-2].md").collect()} == {"dir/f0.md", "dir/f1.md", "dir/f2.md"}
    assert {r.file_path for r in se.search(df, q, 100, meta, min_lines=30).collect()} == {f"dir/f{i}.md" for i in (3, 4, 5, 6)}
    with pytest.raises(ValueError):
        se.search(df, q, 0)


def test_search_keeps_only_what_it_needs_in_the_scan(spark, tmp_path):
    _, df = chunk_table(spark)
    df.withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "c"))
    plan = se.top_k(spark.read.parquet(str(tmp_path / "c")).select("id", "embedding"), {0: [1.0] * 8}, 3)._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "file_path" not in plan


def test_ordinals_and_nth(spark):
    _, df = chunk_table(spark, 20)
    nth = se.fetch_nth(df, "dir/f1.md", 1)
    assert [r.id for r in nth.collect()] == [1] and nth.first().distance == 0
    assert se.fetch_nth(df, "dir/f1.md", 0).count() == 0


def test_rendering(spark):
    kinds = [("whole", None, None), ("chunk", 1, 5), ("chunk", 7, 9), ("image", None, None), ("chunk", 2, 3), ("pdf_page", None, None), ("chunk", None, None)]
    rows = [(i, "a/b.txt", 0.1 * i, k, s, e, 4 if k == "pdf_page" and i < 3 else None) for i, (k, s, e) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "id long, file_path string, distance double, chunk_type string, line_start int, line_end int, page_number int")
    g = se.coalesced(df, None, match=["chunk_type", "line_start", "line_end", "page_number"])
    assert g.select(match_tokens(F.col("matches")).alias("t")).first().t == "whole,L1-5,7-9,OCR,L2-3,P?,chunk"
    j = json.loads(as_json(g).first().json)
    assert list(j) == sorted(j) and j["file"] == "a/b.txt" and "line_start" not in j["matches"][0] and j["matches"][1]["line_start"] == 1
    assert as_text(g).first().line == "a/b.txt ? - whole,L1-5,7-9,OCR,L2-3,P?,chunk (1.0000)"
    assert profile_line(None) == "Profile: (none recorded)"


# maintenance


def test_changes(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    scan_ = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("c", at(3)), ("d", at(1))], "file_path string, file_modified_at timestamp")
    idx = spark.createDataFrame([("b", at(1)), ("c", at(3)), ("d", at(2)), ("e", at(1))], "file_path string, file_modified_at timestamp")
    assert {r.file_path: r.label for r in mt.detect_changes(scan_, idx).collect()} == {"a": "Added", "b": "Updated", "c": "Unchanged", "d": "Unchanged"}
    assert [r.file_path for r in mt.removed_files(scan_, idx).collect()] == ["e"]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", 10.0, 2), ("d", 99.0, 0)], "file_path string, seconds double, chunks long")
    r = mt.timings(df).first()
    assert (r.p50, r.p95) == (2.0, pytest.approx(9.2))
    assert mt.timings(df.where("chunks = 0")).first().p95 == 0


def test_all_failed_guard(spark):
    mix = lambda *o: mt.all_failed(mt.tally(spark.createDataFrame([("Added", x, 0) for x in o], "label string, outcome string, failed long"))).first().all_failed
    assert mix(*["skippedEmbedFailure"] * 3)
    assert not mix("indexed", "skippedEmbedFailure", "skippedEmbedFailure")
    assert not mix("skippedUnreadable", "skippedUnreadable")


# evaluation

PLACES = [(1, 4), (3, 10), (11, 20), (21, None), (None, None), (2, None), (5, 8), (1, 2), (11, 5), (None, 11)]


@pytest.mark.parametrize(("places", "want"), [(PLACES, (29, 6, 4)), ([(None, None)] * 10, (0, 0, 0))])
def test_rubric(spark, places, want):
    rows = [(0, q, rank, f) for q, p in enumerate(places) for f, rank in zip("TS", p, strict=True) if rank] + [(0, q, 50, "z") for q in range(10)]
    results = spark.createDataFrame(rows, "point int, query int, rank int, file string")
    targets = spark.createDataFrame([("T", "T"), ("S", "S")], "target string, file string")
    r = ev.totals(ev.points(ev.target_ranks(results, targets), ev.Rubric(("T", "S"))), ev.Rubric(("T", "S"))).first()
    assert (r.total, r.either, r.both) == want


def test_grid(spark):
    got = [(r["size"], r.overlap) for r in ev.grid(spark, [800, 1200, 800], [0, 20]).orderBy("ordinal").collect()]
    assert got == [(800, 0), (800, 160), (1200, 0), (1200, 240)]
    with pytest.raises(Exception, match="overlap"):
        ev.grid(spark, [100], [100])
    assert ev.parse_ints("1, 2,,3") == [1, 2, 3]
    with pytest.raises(ValueError):
        ev.parse_ints("1,x")


def test_best_point_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 5), (1, 9), (2, 9)], "ordinal int, total int")
    assert ev.best_point(df).first().ordinal == 1


def test_rubric_file(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"target_files": [{"key": "t", "path": "a.md", "label": "A"}, {"key": "s", "path": "b.md", "label": "B"}], "scoring": {"rank_brackets": [{"min": 1, "max": 3, "points": 3}], "absent_points": 0, "top10_threshold": 10}, "queries": [{"n": 1, "text": "x"}]}, indent=1))
    r = ev.Rubric.read(spark, str(p))
    assert r.targets == ("a.md", "b.md") and r.brackets == ((1, 3, 3),) and r.queries == ((1, "x"),)


# sources


def test_scan(spark, tmp_path):
    root = tmp_path / "tree"
    for name, content in {
        "a.txt": b"hello", "sub dir/b ü.md": b"x", "c.bin": b"\x00\x01", "d.unknown": b"plain", ".hidden.txt": b"h", ".git/x.txt": b"g", "node_modules/y.js": b"n", "venv": b"v",
        "keep.log": b"l", "build/z.txt": b"z", "sub/build/w.txt": b"w", "_under.txt": b"u", "Makefile": b"all:", "p+q.txt": b"p",
    }.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    (root / ".vecignore").write_text("# no logs\n*.log\n/build/\n")
    seen = [r.file_path for r in scan(spark, str(root)).collect()]
    assert seen == sorted(["a.txt", "sub dir/b ü.md", "d.unknown", "sub/build/w.txt", "Makefile", "_under.txt", "p+q.txt"])
    assert ".hidden.txt" in {r.file_path for r in scan(spark, str(root), include_hidden=True).collect()}


def test_gitignore(spark, tmp_path):
    root = tmp_path / "g"
    root.mkdir()
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("*.tmp\n")
    (root / "a.tmp").write_text("x")
    (root / "b.txt").write_text("y")
    assert [r.file_path for r in scan(spark, str(root)).collect()] == ["b.txt"]
    assert [r.file_path for r in scan(spark, str(root), respect_gitignore=False).collect()] == ["a.tmp", "b.txt"]
    assert one_file(spark, str(root / "b.txt"), str(root)).first().file_path == "b.txt"


def test_texts_must_be_utf8(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff\xfe"))], "file_path string, content binary")
    assert {r.file_path: r.text for r in texts(df).collect()} == {"a": "ok", "b": None}


def test_page_readers_are_plugged_in(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"1|  |3"))], "file_path string, content binary")
    assert page_chunks(df, "pdf").count() == 0
    register_reader("pdf", lambda b: b.decode().split("|"))
    try:
        got = [(r.chunk_type, r.text, r.page_number) for r in page_chunks(df, "pdf").orderBy("ordinal").collect()]
        assert got == [("whole", "1\n  \n3", None), ("pdf_page", "1", 1), ("pdf_page", "3", 3)]
    finally:
        from cairn.sources import files

        files._READERS.clear()


# store


def files_table(spark, rows):
    return spark.createDataFrame([(p, datetime(2024, 1, d), bytearray(t.encode() if isinstance(t, str) else t)) for p, d, t in rows], "file_path string, file_modified_at timestamp, content binary")


def test_store_life(spark, tmp_path):
    home = str(tmp_path / "home")
    with pytest.raises(BadName):
        VectorStore.create(spark, home, "a b", "/s")
    s = VectorStore.create(spark, home, "notes", "/s")
    with pytest.raises(AlreadyExists):
        VectorStore.create(spark, home, "notes", "/s")
    with pytest.raises(NoSuchStore):
        VectorStore.open(spark, home, "other")
    with pytest.raises(ProfileNotRecorded):
        s.search("x")
    r = s.update(files_table(spark, [("a.txt", 1, "apples and pears"), ("b.txt", 1, "trains on rails"), ("c.txt", 1, ""), ("d.txt", 1, b"\xff"), ("long.txt", 1, "word apples " * 300)]), alias="hashing")
    assert (r.files_scanned, r.added, r.updated, r.removed) == (5, 3, 0, 0)
    assert r.skipped_unreadable == ["c.txt", "d.txt"]
    assert s.search("trains", 2).first().file_path == "b.txt"
    assert {x.file_path: x.line_page_count for x in s.indexed_files.collect()} == {"a.txt": 1, "b.txt": 1, "long.txt": 1}
    # b is newer, a unchanged, long gone, e new
    r = s.update(files_table(spark, [("a.txt", 1, "changed but not newer"), ("b.txt", 2, "boats on rivers"), ("e.txt", 1, "stars")]), alias="hashing")
    assert (r.added, r.updated, r.removed, r.unchanged) == (1, 1, 1, 1)
    assert s.search("boats", 1).first().file_path == "b.txt"
    assert {x.file_path for x in s.chunks.select("file_path").distinct().collect()} == {"a.txt", "b.txt", "e.txt"}
    assert s.chunk("b.txt", 1).first().content_preview == "boats on rivers"
    assert s.log().count() == 2 and s.log().orderBy("added").first().removed == 1
    with pytest.raises(ProfileMismatch):
        s.update(files_table(spark, [("a.txt", 1, "x")]), alias="hashing", size=100, overlap=0)
    assert s.upsert(files_table(spark, [("a.txt", 1, "planets")])).added == 1
    assert s.search("planets", 1).first().file_path == "a.txt"
    assert s.remove("a.txt") == 1 and s.remove("nope") == 0
    assert s.describe()["files"] == 2 and s.size_in_bytes() > 0
    VectorStore.create(spark, home, "twin", "/s")
    with pytest.raises(AmbiguousFolder):
        VectorStore.for_directory(spark, home, "/s")
    assert [x.name for x in VectorStore.catalog(spark, home).collect()] == ["notes", "twin"]
    s.reset()
    assert s.describe()["chunks"] == 0 and s.config().profile is None and s.log().count() == 0
    s.drop()
    assert VectorStore.for_directory(spark, home, "/s").name == "twin"


def test_failed_files_keep_their_rows_and_all_failing_is_an_error(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path), "x", "/s")
    s.update(files_table(spark, [("a.txt", 1, "one"), ("b.txt", 1, "two")]), alias="hashing")
    embedders.register("hashing", lambda ts: [None if "bad" in t else np.ones(64) for t in ts])
    try:
        r = s.update(files_table(spark, [("a.txt", 2, "bad"), ("b.txt", 2, "fine")]), alias="hashing")
        assert (r.updated, r.skipped_embed_failures) == (1, ["a.txt"])
        assert {x.content_preview for x in s.chunks.collect()} == {"one", "fine"}
        with pytest.raises(AllFailed):
            s.update(files_table(spark, [("a.txt", 3, "bad"), ("b.txt", 2, "fine")]), alias="hashing")
        assert s.log().count() == 3
    finally:
        embedders._MODELS.clear()


def test_one_run_at_a_time(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path), "x", "/s")
    s.files.create_once(f"{s.path}/lock", "1")
    with pytest.raises(Busy):
        s.update(files_table(spark, [("a", 1, "x")]), alias="hashing")


def test_log_keeps_the_last_lines(spark, tmp_path):
    f, path = Files(spark), str(tmp_path / "log")
    f.write(path, "".join(f"prefill-{i}\n" for i in range(250)))
    append_log(f, path, "new")
    lines = f.read(path).splitlines()
    assert (len(lines), lines[0], lines[-1]) == (200, "prefill-51", "new")


def test_sweep(spark, tmp_path):
    s = VectorStore.create(spark, str(tmp_path), "x", "/s")
    docs = files_table(spark, [("a.txt", 1, "apples " * 50), ("b.txt", 1, "trains " * 50)])
    got = s.sweep(docs, [100, 200], [0], ev.Rubric(("a.txt", "b.txt"), queries=((1, "apples"), (2, "trains"))), alias="hashing").collect()
    assert [(r["size"], r.overlap) for r in got] == [(100, 0), (200, 0)] and all(r.either == 2 for r in got)
