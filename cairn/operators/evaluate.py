"""Scoring of ranked results against a rubric, over a grid of chunk parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.chunkers import check_parameters


@dataclass(frozen=True)
class Rubric:
    targets: tuple[str, str]
    brackets: tuple[tuple[int, int, int], ...] = ((1, 3, 3), (4, 10, 2), (11, 20, 1))
    top: int = 10
    queries: tuple[tuple[int, str], ...] = ()

    @staticmethod
    def read(spark: SparkSession, path: str) -> Rubric:
        row = spark.read.option("multiLine", True).json(path).first()
        if len(row.target_files) != 2:
            raise ValueError("a rubric has two target files")
        b = tuple((x["min"], x["max"], x["points"]) for x in row.scoring.rank_brackets)
        return Rubric(tuple(t.path for t in row.target_files), b, row.scoring.top10_threshold, tuple((q.n, q.text) for q in row.queries))


def target_ranks(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``results(point, query, rank, file)`` and ``targets(target, file)`` -> first rank of each target in each query, null if absent."""
    asked = results.select("point", "query").distinct().crossJoin(F.broadcast(targets))  # two targets
    first = results.groupBy("point", "query", "file").agg(F.min("rank").alias("rank"))
    return asked.join(first, ["point", "query", "file"], "left").select("point", "query", "target", "rank")


def points(ranks: DataFrame, rubric: Rubric) -> DataFrame:
    """With ``points`` of the first bracket that holds the rank; 0 for an absent target."""
    p = F.lit(0)
    for low, high, value in reversed(rubric.brackets):
        p = F.when(F.col("rank").between(low, high), value).otherwise(p)
    return ranks.withColumn("points", p)


def totals(scored: DataFrame, rubric: Rubric) -> DataFrame:
    """``point, total, either, both``: points, and in how many queries either or both targets are in the first ``top``."""
    hit = F.coalesce(F.col("rank") <= rubric.top, F.lit(False)).cast("int")
    by = scored.groupBy("point", "query").agg(F.sum("points").alias("p"), F.max(hit).alias("e"), F.min(hit).alias("b"))
    return by.groupBy("point").agg(F.sum("p").alias("total"), F.sum("e").alias("either"), F.sum("b").alias("both"))


def best_point(summary: DataFrame, order: str = "ordinal") -> DataFrame:
    """The point of the greatest total; the first of equals."""
    return summary.orderBy(F.desc("total"), order).limit(1)


def grid(spark: SparkSession, sizes: list[int], percents: list[int]) -> DataFrame:
    """``ordinal, size, overlap``: overlaps as shares of sizes, rounded half up; distinct points in the order of their first."""
    s = spark.createDataFrame([(i, v) for i, v in enumerate(sizes)], "i int, size int")
    p = spark.createDataFrame([(j, v) for j, v in enumerate(percents)], "j int, percent int")
    for v in sizes:
        for q in percents:
            check_parameters(v, int(v * q / 100 + 0.5))
    all_ = s.crossJoin(p).select((F.col("i") * len(percents) + F.col("j")).alias("ordinal"), "size", F.round(F.col("size") * F.col("percent") / 100).cast("int").alias("overlap"))
    return all_.groupBy("size", "overlap").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal")


def parse_ints(text: str) -> list[int]:
    """Comma-separated integers; blanks between commas are skipped, anything else is refused."""
    return [int(x.strip()) for x in text.split(",") if x.strip()]
