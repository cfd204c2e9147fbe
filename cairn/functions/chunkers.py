"""Chunkers: by recursive separators, and by lines."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.batches import pieces, trimmed
from cairn.functions.text import BLANK, count_lines, trim
from cairn.schema import BadChunkParameters

SEPARATORS = ("\n\n", "\n", ". ", " ")
_PIECE = "array<struct<text:string,line_start:int,line_end:int>>"


def check_parameters(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise BadChunkParameters(f"size {size}, overlap {overlap}")


@dataclass(frozen=True)
class RecursiveSplitter:
    """Pieces of less than ``size`` characters, merged up to ``size`` with ``overlap``; cut at the coarsest separator present.

    A separator stays at the start of what follows it. A piece that no separator cuts is given whole. Line numbers are found by
    looking for the chunk from the end of the one before, else from the start of the text: with overlap, the look ahead misses
    and repeated text may get the lines of its first place. ``strict_lines`` looks from the start of the one before instead.
    """

    size: int = 1200
    overlap: int = 0
    separators: tuple[str, ...] = SEPARATORS
    strict_lines: bool = False

    def __post_init__(self) -> None:
        check_parameters(self.size, self.overlap)

    def split(self, text: str) -> list[tuple[str, int, int]]:
        if len(text.strip()) <= self.size:
            return []
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        out, cursor = [], 0
        for piece in self._parts(text, self.separators):
            at = text.find(piece, cursor)
            if at < 0:
                at = text.find(piece)
            if at < 0:
                out.append((piece, 1, 1))
                continue
            end = at + len(piece)
            cursor = at + 1 if self.strict_lines else end
            out.append((piece, 1 + bisect_left(breaks, at), 1 + bisect_left(breaks, end)))
        return out

    def _parts(self, text: str, separators: tuple[str, ...]) -> list[str]:
        cut = next((i for i, s in enumerate(separators) if s in text), None)
        sep, finer = (separators[-1], ()) if cut is None else (separators[cut], separators[cut + 1 :])
        head, *rest = text.split(sep)
        out: list[str] = []
        small: list[str] = []
        for part in filter(None, [head, *(sep + r for r in rest)]):
            if len(part) < self.size:
                small.append(part)
                continue
            out += self._merged(small)
            small = []
            out += self._parts(part, finer) if finer else [part]
        return out + self._merged(small)

    def _merged(self, parts: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        total = first = 0
        for part in parts:
            if held[first:] and total + len(part) > self.size:
                out.append("".join(held[first:]).strip())
                while total > self.overlap or (total > 0 and total + len(part) > self.size):
                    total -= len(held[first])
                    first += 1
            held.append(part)
            total += len(part)
        out.append("".join(held[first:]).strip())
        return [o for o in out if o]


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 0, strict_lines: bool = False) -> DataFrame:
    """``key, ordinal`` (from 1), ``chunk_type, text, line_start, line_end``: the whole trimmed text, then the pieces. Blank texts give none."""
    splitter = RecursiveSplitter(size, overlap, strict_lines=strict_lines)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                done = 0
                for keys, texts in pieces(batch, 1):
                    yield chunked(batch.column(0).slice(done, len(keys)), texts)
                    done += len(keys)
        finally:
            trimmed()

    def chunked(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for i, t in enumerate(texts):
            if t is None or not (whole := t.strip()):
                continue
            rows.append((i, 1, "whole", whole, None, None))
            rows += ((i, n, "chunk", *piece) for n, piece in enumerate(splitter.split(t), 2))
        at, ordinal, types, chunks, first, last = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(ordinal, pa.int32()), pa.array(types, pa.string()), pa.array(chunks, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], [key, "ordinal", "chunk_type", "text", "line_start", "line_end"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ordinal int, chunk_type string, text string, line_start int, line_end int")


def line_chunks(text: Column, size: int = 30, overlap: int = 8) -> Column:
    """Runs of ``size`` lines as an array of ``text, line_start, line_end``, by expressions alone.

    A run that does not reach the end is cut before the last line in its last 10 (or just after it) that starts with ``#``; the next
    run's start does not move with the cut. ``\\r\\n`` is one line end. Nothing for texts of at most ``size`` lines.
    """

    def runs_of(lines: Column) -> Column:
        n, step = F.size(lines), max(size - overlap, 1)

        def run(start: Column) -> Column:
            end = F.least(start + F.lit(size), n)
            low = F.greatest(start + F.lit(size - 10), start)
            marks = F.filter(F.sequence(low, F.greatest(end, low)), lambda i: (i < n) & F.get(lines, i).startswith("#"))
            cut = F.when((end < n) & (F.size(marks) > 0), F.array_max(marks)).otherwise(end)
            body = F.array_join(F.slice(lines, start + 1, F.greatest(cut - start, F.lit(0))), "\n")
            return F.struct(F.regexp_replace(body, rf"^{BLANK}+|{BLANK}+$", "").alias("text"), (start + 1).cast("int").alias("line_start"), cut.cast("int").alias("line_end"))

        runs = F.filter(F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), run), lambda c: F.length(c["text"]) > 0)
        return F.when(n > size, runs).otherwise(F.array().cast(_PIECE))

    # the lines are bound as the variable of a lambda: named as an expression they would be split anew for every run and every line looked at
    lines = F.split(text, r"\r\n|[\n\u000B\u000C\r\u0085\u2028\u2029]")
    return F.when(text.isNotNull(), F.flatten(F.transform(F.array(lines), runs_of))).otherwise(F.array().cast(_PIECE))


def extracted(files: DataFrame, size: int = 1200, overlap: int = 0) -> DataFrame:
    """``files(file_path, text)`` -> chunks as ``recursive_chunks`` gives them; a null text (not UTF-8) gives none."""
    return recursive_chunks(files, "file_path", "text", size, overlap)


def text_counts(files: DataFrame) -> DataFrame:
    """``file_path, line_page_count, blank`` of text files; null count where the text is null."""
    return files.select("file_path", count_lines(F.col("text")).alias("line_page_count"), (F.length(trim(F.col("text"))) == 0).alias("blank"))
