"""Rendering of results: match lists, JSON, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import basename, rendered_preview, size_unit


def match_tokens(matches: Column, by_chunk: bool = False) -> Column:
    """``whole``, ``OCR``, ``P<page>``, and line ranges of which only the first of a run bears ``L``; ``C<n>`` by chunk."""

    def one(m: Column, i: Column) -> Column:
        kind, start, end = m["chunk_type"], m["line_start"], m["line_end"]
        lined = (kind == "chunk") & start.isNotNull() & end.isNotNull()
        before = F.get(matches, i - 1)
        run = (i > 0) & F.coalesce((before["chunk_type"] == "chunk") & before["line_start"].isNotNull() & before["line_end"].isNotNull(), F.lit(False))
        text = F.when(kind == "image", "OCR").when(kind == "pdf_page", F.concat(F.lit("P"), F.coalesce(m["page_number"].cast("string"), F.lit("?"))))
        text = text.when(lined, F.concat(F.when(run, "").otherwise("L"), start.cast("string"), F.lit("-"), end.cast("string"))).when(kind == "chunk", "chunk").otherwise("whole")
        return F.concat(F.lit("C"), m["ordinal"].cast("string")) if by_chunk else text

    return F.array_join(F.transform(matches, one), ",")


def as_json(groups: DataFrame) -> DataFrame:
    """One JSON object a row, keys in order, absent values left out; ``groups`` has ``file_path, best_score, matches`` and perhaps metadata."""
    have = set(groups.columns)
    inner = {f.name for f in groups.schema["matches"].dataType.elementType.fields}

    def match(m: Column) -> Column:
        named = {"chunk_index": "ordinal", "chunk_type": "chunk_type", "line_end": "line_end", "line_start": "line_start", "page_number": "page_number", "preview": "content_preview"}
        fields = {k: m[v] for k, v in named.items() if v in inner} | {"score": F.greatest(F.lit(0.0), 1 - m["distance"])}
        return F.struct(*(fields[k].alias(k) for k in sorted(fields)))

    fields = {"file": F.col("file_path"), "score": F.col("best_score"), "matches": F.transform("matches", match)}
    if "file_modified_at" in have:
        fields["modified"] = F.date_format("file_modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if "line_page_count" in have:
        pages = size_unit(F.col("file_path")) == "P"
        fields |= {"line_count": F.when(~pages, F.col("line_page_count")), "page_count": F.when(pages, F.col("line_page_count"))}
    return groups.select(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).alias("json"))


def as_text(groups: DataFrame, by_chunk: bool = False) -> DataFrame:
    """``line``: path, date, size, matches and score; ``?`` and ``-`` for what is unknown."""
    have = set(groups.columns)
    date = F.coalesce(F.date_format("file_modified_at", "yyyy-MM-dd HH:mm"), F.lit("?")) if "file_modified_at" in have else F.lit("?")
    size = F.coalesce(F.concat(F.col("line_page_count").cast("string"), size_unit(F.col("file_path"))), F.lit("-")) if "line_page_count" in have else F.lit("-")
    return groups.select(F.format_string("%s %s %s %s (%.4f)", "file_path", date, size, match_tokens(F.col("matches"), by_chunk), "best_score").alias("line"))


def previews(groups: DataFrame) -> DataFrame:
    return groups.select(basename(F.col("file_path")).alias("name"), F.transform("matches", lambda m: rendered_preview(m["content_preview"])).alias("previews"))


def profile_line(identity: str | None, embedder: str | None = None, dimension: int | None = None) -> str:
    return "Profile: (none recorded)" if identity is None else f"Profile: {identity} ({embedder}, {dimension}d)"
