"""Incremental maintenance: what changed, how the index follows, and what a run has to tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_label(seen: Column, stored: Column) -> Column:
    """``Added`` if unknown, ``Updated`` if strictly newer, else ``Unchanged``."""
    return F.when(stored.isNull(), "Added").when(seen > stored, "Updated").otherwise("Unchanged")


def detect_changes(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """``scan`` (file_path, file_modified_at, ...) with ``label``."""
    old = indexed.select("file_path", F.col("file_modified_at").alias("__stored"))
    return scan.join(old, "file_path", "left").withColumn("label", change_label(F.col("file_modified_at"), F.col("__stored"))).drop("__stored")


def removed_files(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.join(scan.select("file_path"), "file_path", "left_anti")


def replaced(table: DataFrame, new: DataFrame, touched: DataFrame, key: str = "file_path") -> DataFrame:
    """``table`` without the rows of ``touched`` keys, and ``new``."""
    return table.join(touched.select(key).distinct(), key, "left_anti").unionByName(new.select(*table.columns))


def upserted(indexed: DataFrame, new: DataFrame) -> DataFrame:
    return replaced(indexed, new, new)


def removed(table: DataFrame, path: str) -> DataFrame:
    return table.where(F.col("file_path") != path)


def complete_files(embedded: DataFrame, totals: DataFrame) -> DataFrame:
    """The barrier of a file: ``file_path, received, total, failed, complete, ordinals`` where failed chunks have no vector."""
    got = embedded.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("embedding").isNull()).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("embedding").isNotNull(), F.col("ordinal")))).alias("ordinals"),
    )
    joined = totals.join(got, "file_path", "left")
    return joined.select("file_path", F.coalesce("received", F.lit(0)).alias("received"), "total", F.coalesce("failed", F.lit(0)).alias("failed"), (F.coalesce("received", F.lit(0)) >= F.col("total")).alias("complete"), "ordinals")


def outcome(total: Column, embedded: Column) -> Column:
    """Of a file with ``total`` chunks of which so many got a vector."""
    return F.when(embedded > 0, "indexed").when(total > 0, "skippedEmbedFailure").otherwise("skippedUnreadable")


def tally(outcomes: DataFrame) -> DataFrame:
    """One row of ``outcomes(label, outcome, failed)``."""
    ok = F.col("outcome") == "indexed"
    return outcomes.agg(
        F.count_if(ok & (F.col("label") == "Added")).alias("added"), F.count_if(ok & (F.col("label") == "Updated")).alias("updated"),
        F.count_if(F.col("outcome") == "skippedUnreadable").alias("skipped_unreadable"), F.count_if(F.col("outcome") == "skippedEmbedFailure").alias("skipped_embed_failures"),
        F.count_if(ok & (F.col("failed") > 0)).alias("partial_failures"),
    )


def all_failed(row: DataFrame) -> DataFrame:
    """A tally with ``all_failed``: there was work, nothing was indexed and an embedding failed."""
    work = F.col("added") + F.col("updated") + F.col("skipped_unreadable") + F.col("skipped_embed_failures")
    return row.withColumn("all_failed", (work > 0) & (F.col("added") + F.col("updated") == 0) & (F.col("skipped_embed_failures") > 0))


def timings(files: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Sums, and exact percentiles by linear interpolation over files with chunks; 0 where there is none."""
    some = F.when(F.col("chunks") > 0, F.col("seconds"))
    pick = lambda p: F.coalesce(F.percentile(some, F.lit(p)), F.lit(0.0))
    return files.groupBy(*(group or [])).agg(F.sum("seconds").alias("total_seconds"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.sum("chunks").alias("chunks"), F.max("chunks").alias("most_chunks"))


def slowest(files: DataFrame, n: int = 5) -> DataFrame:
    return files.orderBy(F.desc("seconds"), "file_path").limit(n)


def last_n(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` rows."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)


def first_seen(points: DataFrame, key: list[str], order: str) -> DataFrame:
    """Distinct points in the order in which they came first."""
    return points.groupBy(*key).agg(F.min(order).alias(order))


def max_per_group(table: DataFrame, group: str, value: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), order)
    return table.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
