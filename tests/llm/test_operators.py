"""The corpus operators on small tables: against brute force, and on awkward input."""

from __future__ import annotations

import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import bpe_reuse, chat_masks, jaccard_join, lm_trie, metric_join, mixing, quality_rules, substring_dedup, toxicity, url_filter
from cairn.llm.elias_fano import EliasFano
from cairn.llm.graph import components
from cairn.llm.text import Words, pack, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RUN = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")


def words(text):
    return RUN.findall((text or "").lower())


def folded(text):
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or "s")], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def vocabulary(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(3, 8))) for _ in range(n)]


def corpus(n=60, seed=1):
    """Random texts with exact and near copies and shared passages."""
    r, v = random.Random(seed), vocabulary(400)
    texts = [" ".join(r.choices(v, k=r.randint(5, 220))) for _ in range(n)]
    passage = " ".join(r.choices(v, k=64))
    for i in range(0, n, 5):
        texts[i] = f"{texts[i]} {passage.capitalize()}. {r.choice(v)}"
    for i in range(0, n, 4):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 15)):
            w[r.randrange(len(w))] = r.choice(v)
        texts.append(" ".join(w))
    return [*texts, *texts[:6], "x", "", "!!", None, "one two three", "One, two; three!", "ÀÉ 日本 ßİ x", "a " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    df = documents(spark, corpus(), ["s0", "s0", "s1", None])
    return df.cache()


AWKWARD = [
    (None, None, None, None, None), (1, None, "en", "s", 4), (2, "", "en", "s", 0), (None, "some words here", "en", None, 15), (3, "same words here", None, "s", None), (3, "same words here", None, "s", None),
    (4, "long " * 60_000, "en", "s", 1), (5, "tab\tnul\x00 é  😀 " * 30, "en", "t", 3),
]
CLASHES = ["host", "n", "bucket", "TEXT", "Doc_ID", "path", "rate_short", "bad_host", "n_docs", "__keep", "__host", "__src", "__epochs", "epochs", "pos", "rows", "shared", "size", "cell", "id", "a.b", "route", "__key"]


def awkward(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    return df.toDF(*df.columns).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# what they share


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words(texts):
    w = Words(texts)
    own_words = [RUN.findall(folded(t or "")) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in own_words]
    want = [x for own in own_words for x in own]
    by = defaultdict(set)
    for h, x in zip(w.hash.tolist(), want, strict=True):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    for t, d in zip(texts, range(len(texts)), strict=True):
        own = slice(w.first[d], w.first[d + 1])
        a, b = (w.characters(x[own], np.full(len(x[own]), d)) for x in (w.start, w.end))
        assert [folded(t)[i:j] for i, j in zip(a, b, strict=True)] == own_words[d] if t else True


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_pack(values):
    v = np.sort(np.array(values, np.uint64))
    assert (unpack(pack(v)) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=200), st.lists(st.integers(0, 5200), min_size=1, max_size=50))
def test_elias_fano(values, asked):
    v, q = np.sort(np.array(values)), np.array(asked)
    e = EliasFano.decode(EliasFano.encode(v))
    assert (e.access(np.arange(len(v))) == v).all()
    assert (e.successor(q, np.full(len(q), len(v))) == np.searchsorted(v, q)).all()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# operator 1


def brute_model(texts):
    c1 = Counter(w for t in texts for w in words(t))
    name = lambda w: w if c1[w] >= 2 else "<unk>"
    s = [[*map(name, words(t)), "</s>"] if words(t) else [] for t in texts]
    u, b, t3 = (Counter(x for t in s for x in zip(*(t[i:] for i in range(n)), strict=False)) for n in (1, 2, 3))
    t1, t2 = Counter(x[:1] for x in b), Counter(x[:2] for x in t3)
    n, kinds, size = sum(u.values()), len(u), len({w for w in u if w[0] not in ("<unk>", "</s>")}) + 3
    q = lambda p: math.exp(-lm_trie.STEP * min(255, max(0, round(-math.log(max(p, 1e-12)) / lm_trie.STEP))))
    left: dict = defaultdict(lambda: 1.0)
    for low, up, types in ((u, b, t1), (b, t3, t2)):
        for x, k in up.items():
            if k >= 2:
                left[x[:-1]] -= k / (low[x[:-1]] + types[x[:-1]])

    def p(h, w):
        out = (u[(w,)] + kinds / (size - 1)) / (n + kinds)
        if h:
            x = h[-1:]
            out = out * q(left[x]) + (q(b[(*x, w)] / (u[x] + t1[x])) if b[(*x, w)] >= 2 else 0)
        if len(h) == 2 and b[h] >= 2:
            out = out * q(left[h]) + (q(t3[(*h, w)] / (b[h] + t2[h])) if t3[(*h, w)] >= 2 else 0)
        return out

    return [sum(math.log(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)) for t in s]


def test_language_model_agrees_with_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute_model(list(texts.values())), strict=True))
    for r in lm_trie.score_documents(docs).collect():
        assert r.n_tokens == len(words(texts[r.doc_id]))
        assert r.log_probability == pytest.approx(want[r.doc_id], rel=2e-3, abs=0.05)
        assert (r.perplexity is None) == (r.n_tokens == 0)


def test_language_model_prefers_what_it_has_seen(spark, docs):
    path = lm_trie.build(docs)
    seen, v = corpus()[1], vocabulary(400)
    new = " ".join(random.Random(9).choices(v, k=len(words(seen))))
    got = {r.doc_id: r.perplexity for r in lm_trie.score(documents(spark, [seen, new]), path).collect()}
    assert got[0] < got[1]


def test_language_model_on_awkward_input(spark):
    assert lm_trie.score_documents(awkward(spark)).count() == len(AWKWARD)
    assert lm_trie.score_documents(empty(spark)).count() == 0


# operator 2


def test_urls(spark):
    pages = [(i, f"https://{h}/p{i}") for i, h in enumerate(["bad.evil.com"] * 30 + ["good.fine.org"] * 30 + ["new.evil.com"] * 2 + ["once.fine.org"])]
    pages += [(100, None), (101, "no url"), (102, "http://user@A.B.co.uk:80/x"), (None, "http://x.org/"), (103, "http://10.0.0.1/"), (103, "http://10.0.0.1/")]
    labels = [(i, 0 if i < 30 else 1, 0) for i in range(60)] + [(62, 0, 0), (None, 0, 1), (1, None, None), (2, 1, 1), (2, 1, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("HOST", F.lit(1)).withColumn("n", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("bad", F.lit(1))
    got = url_filter.filter_urls(p, lab).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert not by[0].keep and by[31].keep
    assert by[62].keep  # one bad page of a good domain does not condemn the host
    assert by[60].bad_rate > by[31].bad_rate  # an unknown host of a bad domain is suspect
    assert by[100].keep and by[101].keep and by[100].host == ""
    assert (by[102].host, by[102].domain, by[102].suffix) == ("a.b.co.uk", "a.b.co.uk"[2:], "co.uk")
    assert (by[103].domain, by[103].suffix) == ("10.0.0.1", "")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.labelled for r in url_filter.filter_urls(p, none).collect()} == {0}
    assert url_filter.filter_urls(p.limit(0), lab).count() == 0


# operator 3


def shingles(text, n=jaccard_join.N):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(rows, threshold, n=jaccard_join.N):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None and t is not None]
    out = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and a and b and len(a & b) / len(a | b) >= threshold - 1e-12:
            out.add((min(i, j), max(i, j), round(len(a & b) / len(a | b), 6)))
    return out


@pytest.mark.parametrize(("threshold", "n", "hot", "block"), [(0.4, 4, 64, 4096), (0.3, 2, 3, 5), (0.8, 3, 1, 2), (0.6, 1, 2, 4096)])
def test_jaccard_pairs_agree_with_brute_force(spark, docs, monkeypatch, threshold, n, hot, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_a, r.doc_b, r.jaccard) for r in jaccard_join.jaccard_pairs(docs, n, threshold).collect()}
    want = brute_pairs(rows, threshold, n)
    assert want and got == want


def test_a_large_group_of_variants(spark):
    r, v = random.Random(2), vocabulary(300)
    base = r.choices(v, k=80)
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(80)] = r.choice(v)
        texts.append(" ".join(w))
    got = {(x.doc_a, x.doc_b, x.jaccard) for x in jaccard_join.jaccard_pairs(documents(spark, texts)).collect()}
    assert got == brute_pairs(list(enumerate(texts)), jaccard_join.THRESHOLD)


def test_one_of_each_group_stays(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    group = {i: i for i in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b, _ in brute_pairs(list(rows.items()), jaccard_join.THRESHOLD):
        group[max(find(a), find(b))] = min(find(a), find(b))
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in rows})


def test_jaccard_on_awkward_input(spark):
    df = awkward(spark)
    assert jaccard_join.jaccard_pairs(df).collect() == []
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len(AWKWARD) - 1  # the repeated row stands once
    assert jaccard_join.jaccard_pairs(empty(spark)).count() == 0
    assert jaccard_join.drop_near_copies(empty(spark)).count() == 0


# operator 4


def brute_spans(rows, k):
    count = Counter()
    w = [words(t) for _, t in rows]
    for x in w:
        count.update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    out = []
    for (doc, _), x in zip(rows, w, strict=True):
        on = [i for i in range(len(x) - k + 1) if count[tuple(x[i : i + k])] > 1]
        for _, g in itertools.groupby(enumerate(on), lambda p: sum(b - a > k for a, b in itertools.pairwise(on[: p[0] + 1]))):
            g = [i for _, i in g]
            out.append((doc, g[0], g[-1] + k - g[0], max(count[tuple(x[i : i + k])] for i in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [50, 20])
def test_repeated_spans_agree_with_brute_force(spark, docs, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = substring_dedup.repeated_spans(docs, k).collect()
    assert sorted(((r.doc_id, r.first_word, r.n_words, r.copies) for r in found), key=str) == brute_spans(rows, k)
    texts = dict(rows)
    for r in found:
        assert words(texts[r.doc_id][r.span_start : r.span_end]) == words(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]


def brute_cut(rows, k):
    """Cuts every k words that have an earlier place (least id, then text); equal texts count as one."""
    first = {}
    texts = sorted({t: min((i for i, u in rows if u == t and i is not None), default=None) for _, t in rows if t}.items(), key=lambda x: (x[1] is None, x[1]))
    for t, _ in texts:
        w = words(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (t, i))
    out = []
    for i, t in rows:
        places = [(m.start(), m.end()) for m in RUN.finditer((t or "").lower())]
        w, dead = words(t), []
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] != (t, p):
                a, b = places[p][0], places[p + k - 1][1]
                if dead and p <= dead[-1][2]:
                    dead[-1] = (dead[-1][0], b, p + k)
                else:
                    dead.append((a, b, p + k))
        kept, at = "", 0
        for a, b, _ in dead:
            kept, at = kept + t[at:a], b
        out.append((i, t if t is None else kept + t[at:]))
    return out


def test_repeats_are_cut_once(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.cut_repeats(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert {r.doc_id: r.text for r in out} == dict(brute_cut(rows, substring_dedup.K))
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)


def test_paths_are_compacted(spark):
    v = vocabulary(300)
    a, b = " ".join(v[:80]), " ".join(v[100:180])
    texts = [f"{v[200]} {a} {v[201]}", f"{v[202]} {a} {b} {v[203]}", f"{b} {v[204]}"]
    rows = substring_dedup.text_spans(documents(spark, texts)).collect()
    paths = defaultdict(set)
    for r in rows:
        paths[r.path].add(r.edges)
    assert len(paths) == 2  # the passage of texts 0 and 1, that of 1 and 2
    again = " ".join(v[:60] * 3)
    assert substring_dedup.repeated_spans(documents(spark, [again])).first().n_words == 180


def test_compaction_decides_the_spans(spark, docs, monkeypatch):
    whole = substring_dedup.compacted
    monkeypatch.setattr(substring_dedup, "compacted", lambda found: whole(found).where("false"))
    assert substring_dedup.repeated_spans(docs).count() == 0


def test_paths_are_glued_over_many_anchors(spark):
    v = vocabulary(2000, 9)
    long, other = " ".join(v[:900]), " ".join(v[1000:1300])
    texts = [f"{v[950]} {long} {v[951]}", f"{v[952]} {long}", f"{long} {v[953]} {other}", f"{other} {v[954]}"]
    rows = substring_dedup.text_spans(documents(spark, texts)).collect()
    assert sorted((r.edges, r.copies) for r in rows) == [(251, 2)] * 2 + [(851, 3)] * 3
    assert len({r.path for r in rows}) == 2 and sum(r.first for r in rows) == 2


def test_words_at_the_coordinates_are_verified(spark, monkeypatch):
    """Edges whose hashes collide make no span: the texts' own words decide."""
    true = substring_dedup._edges

    def colliding(w, k):
        edge, doc = true(w, k)
        return np.where(edge != 0, np.uint64(7), np.uint64(0)), doc

    v = vocabulary(300, 3)
    w = Words([" ".join(v[:60]), " ".join(v[100:160]), " ".join(v[:60])])
    batch = pa.RecordBatch.from_pydict({"text_key": [1, 2, 3], "text": [" ".join(v[:60]), " ".join(v[100:160]), " ".join(v[:60])], "paths": [[{"path": 7, "edges": 1}]] * 3, "rows": [1, 1, 1], "first_id": [1, 2, 3]})
    monkeypatch.setattr(substring_dedup, "_edges", colliding)
    (out,) = substring_dedup._emit_places(50)([batch])
    said = Counter(zip(out.column("high").to_pylist(), out.column("low").to_pylist(), strict=True))
    assert len(w.first) == 4 and sorted(said.values()) == [1] * 11 + [2] * 11


def test_spans_on_awkward_input(spark):
    df = awkward(spark)
    assert {r.doc_id for r in substring_dedup.repeated_spans(df).collect()} == {4, 5}
    out = substring_dedup.cut_repeats(df)
    assert out.columns == df.columns
    # what stands in one text alone keeps its first place: one word again and again is cut to the words of an edge
    got = sorted((r[0] is None, r[0] or 0, r[1] is None, r[1] or "") for r in out.collect())
    assert got == sorted((i is None, i or 0, t is None, t or "") for i, t in brute_cut([a[:2] for a in AWKWARD], substring_dedup.K))
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0
    assert substring_dedup.cut_repeats(empty(spark)).count() == 0


# operator 5


def test_metric_join_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PER_PIVOT", 2.0)
    monkeypatch.setattr(metric_join, "PART", 30)
    monkeypatch.setattr(metric_join, "MEMBERS", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 12))
    x = np.concatenate([base, base[:60] + 0.08 * rng.normal(size=(60, 12)), base[:5], 3 * base[5:8]])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if round(s[i, j], 9) >= metric_join.COSINE}
    assert len(want) > 50 and {(r.vec_a, r.vec_b) for r in metric_join.near_pairs(df).collect()} == want


def test_metric_join_on_awkward_input(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ID", F.lit(0)).withColumn("v", F.lit(0)).withColumn("cell", F.lit(0))
    assert [(r.vec_a, r.vec_b, r.cosine) for r in metric_join.near_pairs(df).collect()] == [(1, 2, 1.0)]
    assert metric_join.near_pairs(df.limit(0)).count() == 0


# operator 6


def test_water_filling():
    def fill(sizes, weights, budget, cap):
        """Clamp and give away what is left over, until all fit."""
        full, share = {}, dict(weights)
        while True:
            rest = budget - sum(full.values())
            w = sum(share[k] for k in share if k not in full)
            over = [k for k in share if k not in full and w and share[k] * rest / w > cap * sizes[k] + 1e-9]
            if not over:
                return {k: full.get(k, share[k] * rest / w if w else 0) / sizes[k] for k in sizes}
            full |= {k: cap * sizes[k] for k in over}

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = random.Random(8)
    for _ in range(4):
        sizes = {f"s{i}": r.randint(1, 1000) for i in range(r.randint(1, 9))}
        weights = {k: r.random() for k in sizes}
        cap, ratio = r.choice([0.7, 1.0, 2.0, 4.0]), r.choice([0.5, 1.0, 3.0])
        df = spark.createDataFrame([(k, sizes[k], weights[k]) for k in sizes], "src string, size long, weight double")
        got = {x.src: x.epochs for x in mixing.epochs(df, ratio, cap).collect()}
        assert got == pytest.approx(fill(sizes, weights, ratio * sum(sizes.values()), cap), rel=1e-6)


def test_mixing_draws_whole_and_fractional_repetitions(spark):
    docs = documents(spark, [f"text number {i} " * 5 for i in range(600)], ["a", "a", "a", "a", "b"])
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = mixing.mixed(docs, w, 1.0, 1.6)
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by["b"] == pytest.approx(1.6 * 120, rel=0.12) and by["a"] == pytest.approx(600 - 1.6 * 120, rel=0.12)
    assert got.where("source = 'b'").groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first()[:] == (1, 2)
    again = mixing.mixed(docs.repartition(7), w, 1.0, 1.6)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in again.collect())


def test_mixing_on_awkward_input(spark):
    df = awkward(spark)
    out = mixing.mix_stage(df)
    assert out.columns == df.columns and out.count() >= 0
    w = spark.createDataFrame([("s", None), (None, -1.0)], "source string, weight double")
    assert mixing.mixed(spark.createDataFrame(AWKWARD, DOCS), w).count() == 0
    assert mixing.mix_stage(empty(spark)).count() == 0


# operator 7


def test_toxicity_on_held_out_documents(spark):
    r, v = random.Random(6), vocabulary(500)
    bad = ["idiotic", "worthless", "pathetic", "moronic"]

    def text(toxic):
        w = r.choices(v, k=60)
        for _ in range(4 if toxic else 0):
            w[r.randrange(60)] = r.choice(bad)
        return " ".join(w)

    truth = [i % 3 == 0 for i in range(300)]
    docs = documents(spark, [text(t) for t in truth])
    labels = spark.createDataFrame([(i, 1, int(truth[i])) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.toxic for x in toxicity.score_documents(docs, labels).collect()}
    right = sum(got[i] == truth[i] for i in range(150, 300))
    assert right / 150 > 0.95


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 150, 40
    cells = rng.random((n, terms)) < 0.2
    doc, term = np.nonzero(cells)
    count = rng.integers(1, 5, len(doc))
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    idf = 1 + rng.random(terms) * 3
    m = np.zeros((n, terms))
    m[doc, term] = (1 + np.log(count)) * idf[term]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(m @ m.T, 9)
    for width in (4, 64):
        index = toxicity.Index(ids, rng.integers(0, 2, n), doc, term, count, idf, k=7, width=width)
        sims, at, _ = index.nearest(ids, doc, term, count)
        for i in range(n):
            want = sorted(((-s[i, j], ids[j]) for j in range(n) if j != i and s[i, j] > 0))[:7]
            got = [(-a, index.ids[p]) for a, p in zip(sims[i], at[i], strict=True) if p >= 0]
            assert [x[1] for x in got] == [x[1] for x in want] or np.allclose([x[0] for x in got], [x[0] for x in want], atol=2e-9)


def test_toxicity_on_awkward_input(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.score_documents(awkward(spark), none).collect()} == {False}
    labels = spark.createDataFrame([(1, 1, 1), (3, None, 0), (3, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("TOXIC_", F.lit(1))
    assert toxicity.score_documents(awkward(spark), labels).count() == len(AWKWARD)
    assert toxicity.score_documents(empty(spark), labels).count() == 0


# operator 8


def test_quality_rules(spark):
    good = "A plain sentence of several ordinary words stands here."
    texts = [good, "## $$ %% && ## x $$", "LOUD WORDS EVERYWHERE IN THIS TEXT", "the " * 40, "", None, "ok fine"]
    rows = [(i, t, "en", "mixed" if i < 6 else "calm", 0) for i, t in enumerate(texts)] + [(300 + i, good, "en", "calm", 0) for i in range(30)]
    rows += [(100 + i, "the cat cat sat sat on the mat and slept", "en", "bad", 0) for i in range(30)] + [(200, good, "en", "bad", 0), (201, good, "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert [got[i].keep for i in range(7)] == [True, False, False, False, False, False, True]
    assert got[200].keep and got[201].keep and got[201].host == "(none)"
    assert 0 < got[200].host_rate_repeats < 1  # shrunk
    assert sorted(r.doc_id for r in quality_rules.drop_rejected(df).collect()) == sorted(i for i, r in got.items() if r.keep)


def test_bad_hosts_are_held_to_the_soft_limit(spark):
    soft = "the cat cat sat sat on on the mat mat and slept"  # between soft and hard
    good = "A plain sentence of several ordinary words stands here."
    rows = [(i, soft, "en", "bad", 0) for i in range(60)] + [(60 + i, good, "en", f"h{i % 12}", 0) for i in range(240)] + [(500, soft, "en", "h1", 0), (501, good, "en", "bad", 0)]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].bad_host and not got[0].keep
    assert not got[500].bad_host and got[500].keep
    assert got[501].keep


def brute_marks(text):
    """The rules whose soft limits a text breaks, and those whose hard ones."""
    text = text or ""
    w = re.split(r"[\t\n\x0b\f\r ]+", text.strip("\t\n\x0b\f\r "))
    w = [x for x in w if x]
    flat, n = " ".join(w), max(len(w), 1)
    m = {
        "short": -len(w), "symbols": sum(text.count(c) for c in quality_rules.SYMBOLS) / n, "shouting": sum(unicodedata.category(c) == "Lu" for c in flat) / max(len(flat), 1),
        "repeats": sum(a == b for a, b in itertools.pairwise(w)) / n, "exclaims": (text.count("!") + text.count("?")) / n,
    }
    return tuple({r for r, x in quality_rules.RULES.items() if m[r] > (-x[i] if r == "short" else x[i])} for i in (0, 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÉé ßΩ!?#|\n\t\x0b\u00a0😀𝐀"), max_size=40)), max_size=6))
def test_marks_agree_with_brute_force(texts):
    rules = list(quality_rules.RULES)
    got = [tuple({r for i, r in enumerate(rules) if x >> (i + j * len(rules)) & 1} for j in (0, 1)) for x in quality_rules.marks_of(texts).tolist()]
    assert got == [brute_marks(t) for t in texts]


def test_quality_on_awkward_input(spark):
    df = awkward(spark)
    got = quality_rules.quality_verdicts(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.host) for r in got) == sorted((a[0] is None, a[0] or 0, a[3] or "(none)") for a in AWKWARD)
    assert {r.doc_id: r.failed_rules for r in got if r.doc_id is not None} == {a[0]: ",".join(r for r in quality_rules.RULES if r in brute_marks(a[1])[0]) for a in AWKWARD if a[0] is not None}
    kept = quality_rules.drop_rejected(df)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in got)
    assert quality_rules.quality_verdicts(empty(spark)).count() == 0
    assert quality_rules.drop_rejected(empty(spark)).count() == 0


# operator 9


def test_masks_agree_with_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in range(25):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(["word ", "é", "日本", " x\n", "😀", "'s", "<|end|>", "<|endoftext|>", ""]) for _ in range(r.randint(0, 20)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    enc = chat_masks.tokenizer()
    got = {x.conv_id: x for x in chat_masks.format_chats(df).collect()}
    assert set(got) == {x[0] for x in rows}
    for c, x in got.items():
        own = [(role, text) for i, _, role, text in rows if i == c]
        text, spans = "", []
        for role, body in own:
            text += f"<|{role}|>\n"
            spans.append((len(text), len(text) + len(body) + 7, role))
            text += f"{body}<|end|>\n"
        code = enc.encode(text, add_special_tokens=False)
        assert x.text == text and list(x.tokens) == code.ids
        for m, t, (a, b) in zip(x.mask, x.turns, code.offsets, strict=True):
            want = next((i for i, (s, e, _) in enumerate(spans) if s < max(b, a + 1) and a < e), -1)
            assert t == want and m == int(want >= 0 and spans[want][2] == "assistant")


def test_masks_on_awkward_input(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "last"), (2, 0, "assistant", ""), (3, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("TURNS", F.lit(1)).withColumn("t", F.lit(2))
    got = {r.conv_id: r for r in chat_masks.format_chats(df).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 2, 1: 3, 2: 1, 3: 1}
    assert got[1].text.endswith("<|assistant|>\nlast<|end|>\n") and got[2].n_learned > 0
    assert chat_masks.format_chats(df.limit(0)).count() == 0


# operator 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*"ab  \n\t'sdt1,.é日😀%", " the", "don", "\u00a0", "\r\n"]), max_size=600).map("".join), st.integers(2, 40))
def test_joined_chunks_encode_as_the_whole(text, chunk):
    enc, sizes = bpe_reuse.encoding()
    old = bpe_reuse.cuts.__defaults__
    bpe_reuse.cuts.__defaults__ = (chunk,)
    try:
        (chunks,) = bpe_reuse._split([text])
    finally:
        bpe_reuse.cuts.__defaults__ = old
    assert "".join(chunks) == text
    assert list(bpe_reuse.joined(enc, chunks, lambda c: bpe_reuse._encoded(enc, sizes, c))) == enc.encode_ordinary(text)


def test_documents_round_trip(spark, docs):
    enc, _ = bpe_reuse.encoding()
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = bpe_reuse.encode_documents(docs)
    for r in out.collect():
        t = texts[r.doc_id]
        assert r.tokens is None if t is None else (list(r.tokens) == enc.encode_ordinary(t) and r.n_tokens == len(r.tokens) and r.round_trip)
    assert {r.doc_id: r.text for r in bpe_reuse.decode_documents(out).collect()} == texts


def test_equal_passages_are_cut_alike():
    r, v = random.Random(3), vocabulary(300)
    shared = " ".join(r.choices(v, k=2000))
    a, b = bpe_reuse._split([f"{' '.join(r.choices(v, k=300))} {shared}", f"{' '.join(r.choices(v, k=77))} {shared}"])
    assert len(set(a) & set(b)) >= len(a) // 2


def test_encoding_on_awkward_input(spark):
    got = bpe_reuse.encode_documents(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) and sum(r.tokens is None for r in got) == 2
    assert bpe_reuse.encode_documents(empty(spark)).count() == 0

