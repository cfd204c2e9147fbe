"""Operator 9. Chat formatting with loss masks aligned by offsets.

A conversation's turns, in order, are rendered as one text (``<|role|>`` line, the turn's text, a closing line), which is encoded
once with the tokenizer's offsets. The spans of the turns' texts, which ascend, are met with the spans of the tokens by binary search: a token
belongs to the turn in whose span any of its characters lies; where it touches two it is the one of its first character. The mask is 1
on tokens of assistant turns, with their closing mark, and 0 elsewhere.

Defined results: turns are ordered by turn number (null last), then role and text; repeated rows are repeated turns; a null role is
``unknown``, a null text empty; turns of a null conversation form one conversation; a conversation of empty texts has only its marks;
whatever in a text looks like a mark or a special token is ordinary text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrowed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LEARNED = ("assistant",)
CLOSE = "<|end|>"

_loaded: dict[str, object] = {}


def tokenizer(path: str = TOKENIZER):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def rendered(turns: list[dict]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text, and start and end of each turn's own text with its closing mark."""
    parts, starts, ends, at = [], [], [], 0
    for t in turns:
        head, body = f"<|{t['role']}|>\n", f"{t['text']}{CLOSE}"
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        parts += [head, body, "\n"]
        at = ends[-1] + 1
    return "".join(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def turn_of(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The turn of each token of ``offsets`` (a row: start, end), or -1: the first whose span it meets."""
    if not len(starts) or not len(offsets):
        return np.full(len(offsets), -1, np.int64)
    at = np.searchsorted(ends, offsets[:, 0], "right")  # the first turn that ends after the token's start
    near = np.minimum(at, len(starts) - 1)
    # an empty token stands for a byte of the character at its start
    meets = (at < len(starts)) & (starts[near] < np.maximum(offsets[:, 1], offsets[:, 0] + 1))
    return np.where(meets, near, -1)


def format_chats(conversations: DataFrame, path: str = TOKENIZER, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``conv_id, n_turns, n_tokens, n_learned, text, tokens, mask, turns`` for every conversation."""
    c = narrowed(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    grouped = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for batch in batches:
            ids, chats = batch.column(0), batch.column(1).to_pylist()
            for i in range(0, len(chats), 64):
                own = chats[i : i + 64]
                texts = [rendered(t) for t in own]
                codes = enc.encode_batch([t for t, _, _ in texts], add_special_tokens=False)
                turn = [turn_of(s, e, np.array(x.offsets, np.int64).reshape(-1, 2)) for (_, s, e), x in zip(texts, codes, strict=True)]
                mask = []
                for t, chat in zip(turn, own, strict=True):
                    learn = np.array([x["role"] in learned for x in chat] + [False])
                    mask.append(learn[t].astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, len(own)), pa.array([len(x) for x in own], pa.int32()), pa.array([len(x.ids) for x in codes], pa.int32()), pa.array([int(m.sum()) for m in mask], pa.int32()),
                    pa.array([t for t, _, _ in texts], pa.string()), pa.array([x.ids for x in codes], pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int32())), pa.array([t.astype(np.int32) for t in turn], pa.list_(pa.int32())),
                ], ["conv_id", "n_turns", "n_tokens", "n_learned", "text", "tokens", "mask", "turns"])

    return grouped.mapInArrow(run, "conv_id long, n_turns int, n_tokens int, n_learned int, text string, tokens array<int>, mask array<int>, turns array<int>")
