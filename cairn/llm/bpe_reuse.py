"""Operator 10. BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts each text where the hash's low bits are zero, so equal passages
of different documents are cut alike. Documents are brought together by the least hash of their chunks, so that those
that share content meet in one task, and a task encodes each distinct chunk once. Encoded chunks are then
joined: a cut may fall inside a word or a run of spaces, so what lies between the last sure boundaries of
the left chunk and the first of the right is encoded again, with one agreed piece on either side; if those
pieces' tokens differ from the chunks' own, the repair takes in the whole right chunk and goes on, at worst
to the end of the text. A sure boundary is a single space between two visible characters: there the tokenizer's
pattern always begins a new piece. The tokens are those of encoding the whole text, and decoding them gives its bytes.

Reuse is per task and not global: a global dictionary of chunks would send every text through the shuffle twice.

Defined results: a null text has null tokens and count, an empty one no tokens; repeated rows and null ids are encoded
like any; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrowed
from cairn.llm.text import mix, pieces, powers, ranges_hash, released

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 32
#: Chunks have so many bytes on average.
CHUNK = 256
#: A task keeps at most so many characters of chunks, which with their tokens take about three times as many bytes; beyond, the cache starts
#: anew (only speed depends on it).
CACHE_CHARS = 24 << 20

_encodings: dict[str, tuple] = {}
_ROLL = np.uint64(0x2545F4914F6CDD1D)
_UNROLL = np.uint64(pow(int(_ROLL), -1, 1 << 64))


def encoding(path: str = VOCABULARY):
    """The tokenizer, and the bytes of each token; kept for the next call."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path]


def cuts(data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places in UTF-8 bytes before which a chunk ends, by the hash of the ``WINDOW`` bytes before them alone."""
    n = len(data)
    if n <= WINDOW:
        return np.empty(0, np.int64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers(_ROLL, n), out=prefix[1:])
    h = (prefix[WINDOW:n] - prefix[: n - WINDOW]) * powers(_UNROLL, n)[: n - WINDOW]
    # multiplying moves the hash's entropy up, so the test is on the high bits
    at = np.flatnonzero(h * np.uint64(0x9E3779B97F4A7C15) < np.uint64((1 << 64) // chunk)) + WINDOW
    return at[(data[at] & 0xC0) != 0x80]


def _split(texts: list[str]) -> list[list[str]]:
    """Each text's chunks. All texts are hashed at once; cuts that look across a text's start don't count."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = cuts(np.frombuffer(b"".join(parts), np.uint8))
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    out = []
    for p, lo, i, j in zip(parts, begin, np.searchsorted(at, begin[:-1] + WINDOW), np.searchsorted(at, begin[1:]), strict=False):
        ends = [0, *(at[i:j] - lo).tolist(), len(p)]
        out.append([p[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:], strict=False) if a < b])
    return out


def _sure(text: str, at: int) -> bool:
    """Whether the space at ``at`` lies between two visible characters, and so begins a piece."""
    a, b = text[at - 1], text[at + 1]
    return ("!" <= a <= "~" or "À" <= a <= "ɏ") and ("!" <= b <= "~" or "À" <= b <= "ɏ")


def _first(text: str, after: int) -> int:
    at = text.find(" ", after)
    while at != -1 and at + 1 < len(text):
        if _sure(text, at):
            return at
        at = text.find(" ", at + 1)
    return -1


def _last(text: str, before: int) -> int:
    at = text.rfind(" ", 1, before)
    while at > 0:
        if at + 1 < len(text) and _sure(text, at):
            return at
        at = text.rfind(" ", 1, at)
    return -1


def _encoded(enc, sizes: list[int], chunk: str) -> tuple:
    """Tokens of a chunk and, where it has enough sure boundaries, what its joints need."""
    tokens = array("i", enc.encode_ordinary(chunk))
    f1 = _first(chunk, 1)
    f2 = _first(chunk, f1 + 1) if f1 > 0 else -1
    l1 = _last(chunk, len(chunk) - 1)
    l2 = _last(chunk, l1) if l1 > 0 else -1
    if f2 < 0 or l2 < f2:
        return tokens, None

    def ahead(i: int, n: int) -> int:
        while n > 0:
            n -= sizes[tokens[i]]
            i += 1
        return i

    def back(i: int, n: int) -> int:
        while n > 0:
            i -= 1
            n -= sizes[tokens[i]]
        return i

    n1 = ahead(0, len(chunk[:f1].encode()))
    n2 = ahead(n1, len(chunk[f1:f2].encode()))
    m1 = back(len(tokens), len(chunk[l1:].encode()))
    m2 = back(m1, len(chunk[l2:l1].encode()))
    return tokens, (chunk[:f2], n2, tokens[n1:n2], chunk[l2:], m2, tokens[m2:m1])


def joined(enc, chunks: list[str], known) -> array:
    """The tokens of the chunks' concatenation; ``known(chunk)`` gives a chunk's own encoding."""
    out = array("i")
    left, agreed, whole = "", array("i"), True  # the text since the last agreed boundary; whether nothing precedes it
    tail: array | None = array("i")  # the tokens of ``left`` if it ends the text
    for chunk in chunks:
        tokens, joint = known(chunk)
        if whole and not left and joint:  # the first chunk needs no repair at its start
            out += tokens[: joint[4]]
            left, agreed, tail, whole = joint[3], joint[5], tokens[joint[4] :], False
            continue
        if whole and not left:
            left, tail = chunk, tokens
            continue
        if joint:
            again = array("i", enc.encode_ordinary(left + joint[0]))
            head = joint[2]
            if again[: len(agreed)] == agreed and again[len(again) - len(head) :] == head:
                out += again
                out += tokens[joint[1] : joint[4]]
                left, agreed, tail, whole = joint[3], joint[5], tokens[joint[4] :], False
                continue
        left, tail = left + chunk, None
    out += array("i", enc.encode_ordinary(left)) if tail is None else tail
    return out


@released
def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each document's least chunk hash, or a hash of its place for texts of no chunk."""
    for batch in batches:
        keys = []
        for (texts,) in pieces(batch.select(["text"]), 0):
            parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            data = np.frombuffer(b"".join(parts), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            at = cuts(data)
            keep = at >= begin[np.searchsorted(begin, at, "right") - 1] + WINDOW
            edge = np.unique(np.concatenate([begin, at[keep]]))
            h = ranges_hash(data, edge[:-1], edge[1:]) if len(edge) > 1 else np.empty(0, np.uint64)
            first = np.searchsorted(edge, begin)
            key = mix(np.arange(len(texts), dtype=np.uint64))
            full = np.flatnonzero(np.diff(begin) > 0)
            if len(full):
                key[full] = np.minimum.reduceat(h, first[full])
            keys.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], [*batch.schema.names, "route"])


def _lists(tokens: list[array | None]) -> pa.Array:
    """A column of lists without an object a token."""
    ends = np.cumsum([0, *(len(k or ()) for k in tokens)])
    flat = np.frombuffer(b"".join(memoryview(k).cast("B") for k in tokens if k), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([k is None for k in tokens]))


def _encode(path: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(path)
        _encodings.clear()  # the task's own; an idle worker does not keep it
        cache: dict[str, tuple] = {}
        held = 0

        def known(chunk: str) -> tuple:
            nonlocal held
            got = cache.get(chunk)
            if got is None:
                if held > CACHE_CHARS:
                    cache.clear()
                    held = 0
                got = cache[chunk] = _encoded(enc, sizes, chunk)
                held += len(chunk)
            return got

        for batch in batches:
            for ids, texts, sources in pieces(batch, 1):
                chunks = _split([t or "" for t in texts])
                tokens = [None if t is None else joined(enc, c, known) for t, c in zip(texts, chunks, strict=True)]
                back = [None if t is None else enc.decode_bytes(k.tolist()) == t.encode("utf-8", "surrogatepass") for t, k in zip(texts, tokens, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array([None if k is None else len(k) for k in tokens], pa.int32()),
                    _lists(tokens), pa.array(back, pa.bool_()),
                ], ["doc_id", "source", "n_tokens", "tokens", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, tokens, round_trip`` for every row of ``docs``."""
    given = narrowed(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    routed = given.mapInArrow(_route, "doc_id long, text string, source string, route long")
    # rebalancing by the key keeps sharers together and still cuts a partition that a hot key makes too large
    return routed.hint("rebalance", F.col("route")).select("doc_id", "text", "source").mapInArrow(_encode(path), "doc_id long, source string, n_tokens int, tokens array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` back from tokens; null tokens give a null text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(path)
        for batch in batches:
            texts = [None if k is None else enc.decode_bytes(k).decode("utf-8", "surrogatepass") for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")
