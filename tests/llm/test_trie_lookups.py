"""The trie's n-grams sorted and looked up in few passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairn.llm import lm_trie, text
from tests.llm.test_operators import corpus, documents


def test_few_words_of_a_large_vocabulary_are_sorted_as_one_number(tmp_path, monkeypatch):
    """The limit is on the words that are held at once, not on the vocabulary, beyond whose 2**21 words all was sorted by two columns."""
    few = ["a b a c", "b c", None, "c a b"]
    w = text.Words([" ".join(f"w{i}" for i in range(5000)) + " a b c"])
    words = np.unique(w.hash)
    count = np.ones(len(words) + lm_trie.FIRST, np.int64)
    lm_trie._save(str(tmp_path), "words", words)
    lm_trie._save(str(tmp_path), "before", np.concatenate([[0], np.cumsum(count)]))
    batch = pa.RecordBatch.from_arrays([pa.array(few)], ["text"])

    def runs():
        return [r for b in lm_trie._emit(str(tmp_path), 3)(iter([batch])) for r in b.to_pylist()]

    want = runs()
    monkeypatch.setattr(lm_trie, "NARROW", 4)
    monkeypatch.setattr(np, "lexsort", None)
    monkeypatch.setattr(lm_trie, "_order", None, raising=False)
    assert want and runs() == want


def test_scores_do_not_depend_on_how_many_words_are_looked_up_at_once(spark, monkeypatch):
    df = documents(spark, corpus())
    path = lm_trie.build(df, lm_trie.ALL)
    want = sorted(map(repr, lm_trie.score(df, path).collect()))
    monkeypatch.setattr(lm_trie, "LOOKUPS", 1)
    monkeypatch.setattr(lm_trie, "BYTES", 64)
    assert sorted(map(repr, lm_trie.score(df, path).collect())) == want
