"""Exact vector search: distances, top-k, grouping by file, filters, ordinals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import matches_glob
from cairn.functions.vectors import batch_distances
from cairn.schema import DimensionMismatch


def distances(chunks: DataFrame, queries: dict[int, list[float]], k: int | None = None, id_column: str = "id", embedding: str = "embedding", decimals: int | None = None) -> DataFrame:
    """``chunks`` without its vectors, for each query, with ``query_id`` and ``distance``; rows without a vector are left out.

    With ``k`` each task keeps only its ``k`` nearest per query (ties by id), which hold the global ones: what follows sorts
    tasks times ``k`` rows, however large the table is. Queries of a length differ from the rows' ones are at distance 1. With ``decimals``
    distances are rounded before they are ranked, so that near ties go by id.
    """
    ids = list(queries)
    dims = {len(q) for q in queries.values()}
    if len(dims) > 1:
        raise DimensionMismatch(max(dims), min(dims))
    matrix = chunks.sparkSession.sparkContext.broadcast(np.array([queries[i] for i in ids], np.float64).reshape(len(ids), -1))
    kept = [f for f in chunks.schema.fields if f.name != embedding]
    names = [f.name for f in kept]
    schema = T.StructType([T.StructField("query_id", T.LongType()), *kept, T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = matrix.value
        held: dict[int, pa.Table] = {}
        for batch in batches:
            at, d = batch_distances(batch.column(len(names)), q)
            d = d if decimals is None else np.round(d, decimals)
            rows = pa.Table.from_arrays(batch.columns[: len(names)], names).take(pa.array(at))
            for j, i in enumerate(ids):
                own = rows.append_column("distance", pa.array(d[:, j])).add_column(0, "query_id", pa.array(np.full(len(at), i)))
                if k is None:
                    yield from own.to_batches()
                    continue
                if i in held:
                    own = pa.concat_tables([held[i], own])
                if own.num_rows > k:
                    own = own.sort_by([("distance", "ascending"), (id_column, "ascending")]).slice(0, k)
                held[i] = own
        for t in held.values():
            yield from t.combine_chunks().to_batches()

    return chunks.select(*names, embedding).mapInArrow(run, schema)


def top_k(chunks: DataFrame, queries: dict[int, list[float]], k: int, id_column: str = "id", embedding: str = "embedding", decimals: int | None = None) -> DataFrame:
    """The ``k`` nearest of each query with ``rank``; ties by id."""
    w = Window.partitionBy("query_id").orderBy("distance", id_column)
    return distances(chunks, queries, k, id_column, embedding, decimals).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coalesced(hits: DataFrame, limit: int | None, group: str = "file_path", id_column: str = "id", match: list[str] | None = None) -> DataFrame:
    """Hits by file: ``group, best_score, matches`` (nearest first) and the ``limit`` best files, ties by name.

    The best score is shown as 0 where it is below, but files go by what it was; no or a negative number of files wanted gives none; ``None`` gives all.
    """
    fields = [F.col("distance"), F.col(id_column), *(F.col(c) for c in match or [] if c != id_column)]
    groups = hits.groupBy(group).agg(F.greatest(F.lit(0.0), F.max(1 - F.col("distance"))).alias("best_score"), F.array_sort(F.collect_list(F.struct(*fields))).alias("matches"))
    return groups if limit is None else best(groups, limit, group)


def best(groups: DataFrame, limit: int, group: str = "file_path") -> DataFrame:
    return groups.orderBy(F.desc(1 - F.col("matches")[0]["distance"]), group).limit(max(limit, 0))


def ordinals(chunks: DataFrame, file: str = "file_path", id_column: str = "id") -> DataFrame:
    """``id, ordinal``: the place of a chunk in its file, from 1."""
    return chunks.select(file, id_column, F.row_number().over(Window.partitionBy(file).orderBy(id_column)).alias("ordinal"))


def fetch_nth(chunks: DataFrame, path: str, index: int, file: str = "file_path", id_column: str = "id") -> DataFrame:
    """The chunk at a place of a file, with distance 0; none for places below 1."""
    own = chunks.where(F.col(file) == path)
    at = F.row_number().over(Window.partitionBy(file).orderBy(id_column))
    return own.withColumn("ordinal", at).where(F.col("ordinal") == index).withColumn("distance", F.lit(0.0))


def at_least_lines(metadata: DataFrame, least: int) -> Column:
    """Files of unknown length do not pass."""
    return metadata["line_page_count"] >= least


def search(chunks: DataFrame, query: list[float], limit: int = 10, metadata: DataFrame | None = None, glob: str | None = None, min_lines: int | None = None, pool_factor: int = 3, pool: int | None = None, with_ordinals: bool = False, group: str = "file_path", id_column: str = "id", match: list[str] | None = None) -> DataFrame:
    """Files by their best chunk: ``group, best_score, matches`` and, with ``metadata``, the file's columns.

    Without a filter the files come from the ``pool_factor * limit`` nearest chunks (or ``pool``), so there may be fewer than ``limit``;
    with one, from all chunks, and the matches of a file are then all of its chunks.
    """
    if limit <= 0:
        raise ValueError("limit must be above 0")
    filtered = glob is not None or min_lines is not None
    source = chunks
    if glob is not None:  # a property of the file, so it may be tested before grouping
        source = source.where(matches_glob(F.col(group), glob))
    if min_lines is not None:
        if metadata is None:
            raise ValueError("min_lines needs metadata")
        source = source.join(metadata.where(F.col("line_page_count") >= min_lines).select(group), group, "left_semi")
    hits = distances(source, {0: query}, None, id_column) if filtered else top_k(source, {0: query}, pool or limit * pool_factor, id_column)
    if with_ordinals:
        hits = hits.join(ordinals(chunks, group, id_column).select(id_column, "ordinal"), id_column, "left")
    found = coalesced(hits, limit, group, id_column, [*(match or []), *(["ordinal"] if with_ordinals else [])])
    return found if metadata is None else found.join(metadata, group, "left")
