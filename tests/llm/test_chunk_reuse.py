"""Chunks small enough for passages that documents share."""

from __future__ import annotations

import random

from cairn.llm import bpe_reuse


def test_a_shared_passage_is_reused():
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(n))
    shared = sizes = 0
    for _ in range(20):
        passage = text(200)
        a, b = bpe_reuse._split([f"{text(60)} {passage} {text(60)}", f"{text(70)} {passage} {text(50)}"])
        shared += sum(len(c) for c in set(a) & set(b))
        sizes += len(passage)
    assert shared > 0.5 * sizes
