from __future__ import annotations

import fnmatch
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.functions import vectors as vx
from cairn.functions.chunkers import RecursiveSplitter, check_parameters, line_chunks, recursive_chunks
from cairn.functions.embedders import DEFAULT_ALIAS, REGISTRY, embedded, hashing_buckets, hashing_vectors, make_profile, register, resolve
from cairn.schema import BadChunkParameters, BadIdentity, PartialOverride, UnknownProfile


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


# chunkers


def test_blank_and_fitting_texts_have_no_pieces():
    assert RecursiveSplitter(1200, 240).split("") == []
    assert RecursiveSplitter(1200, 240).split(" \n\t ") == []
    assert RecursiveSplitter(100, 10).split("short text") == []


def test_paragraphs_stay_within_the_size():
    got = RecursiveSplitter(100, 0).split("\n\n".join(["word " * 30] * 3))
    assert len(got) >= 2 and all(len(t) <= 200 for t, _, _ in got)


def test_sentences():
    got = RecursiveSplitter(200, 20).split("This is a sentence of some length. " * 40)
    assert len(got) > 1 and all(t for t, _, _ in got)


def test_a_piece_that_nothing_cuts_is_whole():
    assert [len(t) for t, _, _ in RecursiveSplitter(2000, 100).split("x" * 3000)] == [3000]


def test_overlap_repeats_a_tail():
    got = [t for t, _, _ in RecursiveSplitter(200, 50).split("".join(f"Sentence number {i:02d} is here for the test. " for i in range(40)))]
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(got, got[1:], strict=False))


def test_lines_ascend():
    text = "\n\n".join("\n".join(f"block {b} line {i}" for i in range(20)) for b in range(3))
    got = RecursiveSplitter(300, 0).split(text)
    assert all(1 <= a <= b for _, a, b in got)
    assert [a for _, a, _ in got] == sorted(a for _, a, _ in got)


def test_the_line_cursor_quirk_and_its_cure():
    text = " ".join(f"w{i:03d}" for i in range(30)) + "\n" + " ".join(f"v{i:03d}" for i in range(200))
    loose, strict = RecursiveSplitter(100, 40).split(text), RecursiveSplitter(100, 40, strict_lines=True).split(text)
    assert [t for t, _, _ in loose] == [t for t, _, _ in strict]
    assert all(text.split("\n")[a - 1] for _, a, _ in strict)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(1, 60))
def test_without_overlap_nothing_but_blanks_is_lost(text, size):
    got = RecursiveSplitter(size, 0).split(text)
    if got:
        squeeze = lambda s: "".join(s.split())
        assert squeeze("".join(t for t, _, _ in got)) == squeeze(text)


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (10, 10), (10, -1)])
def test_chunk_parameters(size, overlap):
    with pytest.raises(BadChunkParameters):
        check_parameters(size, overlap)


@pytest.mark.parametrize(
    ("lines", "size", "overlap", "starts"),
    [([f"l{i}" for i in range(100)], 50, 10, [1, 41, 81]), ([f"l{i}" for i in range(50)], 20, 5, [1, 16, 31, 46]), (["a"] * 20, 30, 8, [])],
)
def test_line_chunks(spark, lines, size, overlap, starts):
    assert [c.line_start for c in one(spark, lambda c: line_chunks(c, size, overlap), "\n".join(lines))] == starts


def test_line_chunks_are_cut_before_a_heading(spark):
    lines = [f"l{i}" for i in range(1, 81)]
    lines[45] = "# head"
    got = one(spark, lambda c: line_chunks(c, 50, 10), "\r\n".join(lines))
    assert (got[0].line_start, got[0].line_end) == (1, 45)
    assert got[1].line_start == 41


def test_whole_chunk_comes_first(spark):
    df = spark.createDataFrame([("a", " one\ntwo\nthree "), ("b", "  "), ("c", None), ("d", "word " * 600)], "p string, t string")
    rows = recursive_chunks(df, "p", "t").orderBy("p", "ordinal").collect()
    assert [(r.p, r.chunk_type) for r in rows if r.p != "d"] == [("a", "whole")]
    assert rows[0].text == "one\ntwo\nthree"
    assert [r.chunk_type for r in rows if r.p == "d"][:2] == ["whole", "chunk"]


def test_chunks_are_made_a_run_of_texts_at_a_time():
    """What a worker holds follows neither the number of texts nor the size of Arrow's batches."""

    class Docs:
        dtypes = [("p", "string"), ("t", "string")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [None if i % 50 == 0 else "  " if i % 50 == 1 else f"{i} " + "some words of a line.\n" * (i % 300) for i in range(3000)]
    batch = pa.record_batch([pa.array([f"k{i}" for i in range(len(texts))]), pa.array(texts)], ["p", "t"])
    run = recursive_chunks(Docs(), "p", "t", 1200, 240)
    got, most = [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch.slice(0, 0), batch.slice(7)])):
            most = max(most, out.nbytes)
            got += [(i, n) for i, n in zip(out["p"].to_pylist(), out["ordinal"].to_pylist(), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    splitter = RecursiveSplitter(1200, 240)
    assert got == [(f"k{i}", n) for i, t in enumerate(texts) if i >= 7 and t and t.strip() for n in range(1, 2 + len(splitter.split(t)))]
    assert most < 4 << 20
    assert peak < 12 << 20


def test_long_texts_come_one_at_a_time():
    class Docs:
        dtypes = [("p", "long"), ("t", "string")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = ["some words of a line.\n" * 30_000, "short", "x y " * 150_000]
    out = list(recursive_chunks(Docs(), "p", "t", 1200, 0)(iter([pa.record_batch([pa.array([1, 2, 3]), pa.array(texts)], ["p", "t"])])))
    assert [sorted(set(b["p"].to_pylist())) for b in out] == [[1], [2], [3]]
    assert [b["text"][0].as_py() for b in out] == [t.strip() for t in texts]


# text


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("a\n\n", 2)])
def test_count_lines(spark, text, n):
    assert one(spark, tx.count_lines, text) == n


def test_trim_takes_unicode_blanks(spark):
    assert one(spark, tx.trim, "   a b　\n") == "a b"


@pytest.mark.parametrize(("path", "want"), [("/bar/a/b.txt", "a/b.txt"), ("/bar", ""), ("/bar/", ""), ("/barbell/x.txt", "x.txt"), ("/else/y.md", "y.md"), ("/bar/./c.txt", "c.txt")])
def test_relative_path(spark, path, want):
    assert one(spark, lambda c: tx.relative_path(c, "/bar"), path) == want


@pytest.mark.parametrize("pattern", ["*.md", "a?c", "[a-c]x", "[!a]x", "a.b", "x[", "*a*b*", "[]]x", "f(1)+", "[a^]x"])
def test_globs_agree_with_fnmatch(spark, pattern):
    names = ["a.md", "abc", "ac", "ax", "bx", "dx", "a.b", "aXb", "x[", "zaab", "]x", "f(1)+", "^x", "A.md", "", "n\nb"]
    df = spark.createDataFrame([(n,) for n in names], "v string").select("v", F.col("v").rlike(tx.glob_to_regex(pattern)).alias("x"))
    assert {r.v: r.x for r in df.collect()} == {n: fnmatch.fnmatchcase(n, pattern) for n in names}


def test_glob_backslash(spark):
    assert one(spark, lambda c: c.rlike(tx.glob_to_regex(r"a\*b")), "a*b") is True
    assert one(spark, lambda c: c.rlike(tx.glob_to_regex(r"a\*b")), "axb") is False


@pytest.mark.parametrize(
    ("rule", "hit", "miss"),
    [("build/", ["build/a", "x/build/a"], ["builder/a", "build"]), ("/build/", ["build/a"], ["x/build/a"]), ("/a.txt", ["a.txt"], ["x/a.txt"]), ("*.log", ["a.log", "x/y/a.log"], ["a.log.txt"]), ("docs/*.md", ["docs/a.md", "docs/x/a.md"], ["x/docs/a.md"])],
)
def test_ignore_rules(spark, rule, hit, miss):
    df = spark.createDataFrame([(p,) for p in hit + miss], "v string").where(tx.is_ignored(F.col("v"), tx.ignore_patterns(f"# c\n\n {rule} \n")))
    assert {r.v for r in df.collect()} == set(hit)


@pytest.mark.parametrize(("name", "want"), [("My Notes", "My-Notes"), ("a//b", "a-b"), ("-x-", "x"), ("ä_1", "ä_1"), ("...", "")])
def test_sanitized_name(spark, name, want):
    assert one(spark, tx.sanitized_name, name) == want


def test_valid_names():
    assert tx.valid_name("notes-1_x") and tx.valid_name("sweep")
    assert not any(map(tx.valid_name, ("", "a b", "list", "a/b")))


@pytest.mark.parametrize(("s", "want"), [(1.5, "1.5s"), (0.25, "250ms"), (1.0, "1.0s")])
def test_seconds_text(spark, s, want):
    assert one(spark, tx.seconds_text, s, "double") == want


# vectors


def test_cosine_distance_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 2.0), ([1.0], [1.0, 2.0], 1.0), ([], [], 1.0), ([0.0, 0.0], [1.0, 0.0], 1.0), ([float("nan"), 1.0], [1.0, 1.0], 1.0)]
    df = spark.createDataFrame([(a, b, d) for a, b, d in rows], "a array<float>, b array<float>, d double")
    for r in df.select("d", vx.cosine_distance(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == pytest.approx(r.d)


def test_normalize_and_pack(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r.x) for r in df.select(vx.l2_normalize(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(F.length(vx.pack("v")).alias("n")).first().n == 8
    assert [list(r.x) for r in df.select(vx.unpack(vx.pack("v")).alias("x")).collect()] == [[3.0, 4.0], [0.0, 0.0]]


# profiles and embedders


@pytest.mark.parametrize("identity", ["nomic@1200/240", "nomic@500/100", "nl@2000/0", "hashing@100/10"])
def test_identities_round_trip(identity):
    assert resolve(identity).identity == identity


@pytest.mark.parametrize("identity", ["", "nomic", "nomic@", "nomic@0/0", "nomic@01/0", "nomic@10/007", "nomic@10/", "NOMIC@10/0", " nomic@10/0", "nomic@10/0 ", "nomic@-1/0", "nomic@1.5/0", "@10/0", "nomic@10/0/0"])
def test_bad_identities(spark, identity):
    with pytest.raises(BadIdentity):
        resolve(identity)
    assert one(spark, tx.parse_identity, identity) is None


def test_profiles():
    assert make_profile().alias == DEFAULT_ALIAS == "e5-base" and make_profile().built_in
    assert not make_profile("nl", 100, 10).built_in and make_profile("nl", 2000, 200).built_in
    assert len(REGISTRY) == 10
    for bad, args in ((PartialOverride, ("nl", 100)), (UnknownProfile, ("nope",)), (BadChunkParameters, ("nl", 10, 10))):
        with pytest.raises(bad):
            make_profile(*args)


def test_hashing_embedder_agrees_with_its_expression(spark):
    texts = ["The quick brown fox", "", "ÄÖ 12 12 x", "...", "a b a"]
    want = hashing_vectors(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hashing_buckets(F.col("t")).alias("v"))
    for r in df.collect():
        w = want[r.i]
        assert np.allclose(r.v, [] if w is None else w)


def test_embedding_failures_are_null(spark):
    def fails_on_bad(texts):
        return [None if "bad" in t else np.ones(64) for t in texts]

    register("hashing", fails_on_bad)
    try:
        df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "  "), (4, None)], "i int, text string")
        got = {r.i: r.embedding for r in embedded(df, make_profile("hashing")).collect()}
        assert [got[i] is None for i in (1, 2, 3, 4)] == [False, True, True, True]
    finally:
        from cairn.functions import embedders

        embedders._MODELS.clear()
