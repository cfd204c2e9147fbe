"""The trie of all n-grams, and sequences written in parts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import lm_trie
from cairn.llm.elias_fano import EliasFano
from cairn.llm.queries import LLM_QUERIES


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.lists(st.integers(0, 300), max_size=6))
def test_elias_fano_in_parts(values, cuts):
    v = np.sort(np.array(values)).astype(np.int64)
    want = EliasFano.encode(v)
    got = {k: np.zeros(n, t) for k, (t, n) in EliasFano.sizes(len(v), int(v[-1])).items()}
    cuts = sorted({0, len(v), *(c for c in cuts if c < len(v))})
    edges = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner, edge = EliasFano.part(v[a:b], a, int(want["head"][1]))
        edges.append(edge)
        for k, (at, x) in inner.items():
            got[k][at : at + len(x)] = x
    for k, at, x in EliasFano.seams(edges[::-1], len(v), len(got["high"])):
        got[k][at : at + len(x)] = x
    for k, x in got.items():
        assert x.tolist() == want[k].tolist(), k


def whole_model(texts):
    s = [[*w, "</s>"] if (w := re.findall(r"[0-9a-z]+", t)) else [] for t in texts]
    u, b, t3 = (Counter(x for t in s for x in zip(*(t[i:] for i in range(n)), strict=False)) for n in (1, 2, 3))
    t1, t2 = Counter(x[:1] for x in b), Counter(x[:2] for x in t3)
    n, kinds = sum(u.values()), len(u)

    def p(h, w):
        out = (u[(w,)] + kinds / (kinds + 1)) / (n + kinds)
        for up, low, types, x in ((b, u, t1, h[-1:]), (t3, b, t2, h)):
            if x and (up is b or len(h) == 2):
                all_ = low[x] + types[x]
                kept = sum(k for y, k in up.items() if y[:-1] == x)
                out = out * (1 - kept / all_) + up[(*x, w)] / all_
        return out

    return [sum(math.log(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)) for t in s], (u, b, t3)


def test_the_query_keeps_every_word_bigram_and_trigram(spark, tmp_path):
    r = random.Random(4)
    v = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(v, k=r.randint(1, 40))) for _ in range(30)] + ["once seen words", "", "w1"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want, (u, b, t3) = whole_model(texts)
    trie = lm_trie.Trie(lm_trie.build(docs, lm_trie.ALL))
    assert (len(trie.words), trie.seq2.n, trie.seq3.n) == (len(u) - 1, len(b), len(t3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in LLM_QUERIES["op1_lm_trie"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i].unknown == 0
        # weights are quantised in steps of STEP, each at most half a step away
        assert abs(got[i].log_probability - w) <= lm_trie.STEP / 2 * (got[i].n_tokens + 1) + 1e-6
    assert sum(got[i].log_probability for i in got) == pytest.approx(sum(want), rel=0.01)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400), st.lists(st.integers(0, 3200), min_size=1, max_size=60), st.integers(0, 400))
def test_elias_fano_finds_what_is_there(values, asked, end):
    v, q = np.sort(np.array(values)), np.array(asked)
    e = EliasFano.decode(EliasFano.encode(v))
    ends = np.full(len(q), min(end, len(v)))
    at, same = e.find(q, ends)
    want = np.minimum(np.searchsorted(v, q), ends)
    assert (at == want).all()
    assert (same == [a < b and v[a] == x for a, b, x in zip(want, ends, q, strict=True)]).all()


def test_wide_word_numbers_give_the_same_runs(tmp_path, monkeypatch):
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(0, 60))) for _ in range(20)]
    w = np.unique(lm_trie.Words(texts).hash)
    lm_trie._save(str(tmp_path), "words", w)
    lm_trie._save(str(tmp_path), "before", np.arange(len(w) + lm_trie.FIRST + 1))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [x.to_pylist() for x in lm_trie._emit(str(tmp_path), 4)([batch])]
    monkeypatch.setattr(lm_trie, "NARROW", 0)
    assert got == [x.to_pylist() for x in lm_trie._emit(str(tmp_path), 4)([batch])]
