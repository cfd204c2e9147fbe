"""Operator 6. Mixing sources to target weights by capped water-filling.

A source of ``size`` characters asked for the share ``w`` of a budget would be repeated
``w * budget / size`` times. No source may exceed ``max_epochs``: those that would are clamped there,
and what they leave is given to the others in proportion to their weights, until none exceeds it. That
fixed point has a closed form: with the sources in the order of the level ``max_epochs * size / w`` at
which each saturates, the final level is the budget less the capacity of the saturated, over the weight
of the rest; one ordered pass over the source table (a row a source, not a row a document) finds it.
A document is then taken ``floor(epochs)`` times, and once more when a seeded hash of its id and text is
below the fraction.

Defined results: the size of a document is the length of its text, 0 for null; a null source is the
source ``(none)``; a source without a character is not taken; weights that are null or not
above zero count as zero; if the budget exceeds all capacity every source gets ``max_epochs``. Repeated
rows draw the same hash, so they are taken or left together; null ids draw by text alone. Sources whose levels tie are taken in the order of their names, which changes nothing: they saturate together.
Extra columns pass; an empty table gives none; long texts count in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import guarded, narrowed, small, written

MAX_EPOCHS = 2.0
SEED = "cairn-mix-1"
#: Without given weights a source's weight is its size to this power, which lifts small sources over a hot one.
TEMPERATURE = 0.5
#: The query's target: these sources are wanted so many times over. The stage of the pipeline wants none more than another.
WANTED = {"src3": 6.0, "src7": 6.0}


def epochs(sizes: DataFrame, budget_ratio: float = 1.0, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes(src, size, weight)`` -> ``src, size, weight, epochs``; the budget is ``budget_ratio`` times all size."""
    s = sizes.where(F.col("size") > 0).withColumn("w", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(0.0)))
    s = s.withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    s = s.withColumn("level", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
    order = Window.orderBy(F.col("level").asc_nulls_last(), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap"))).over(before), F.lit(0.0)))
    s = s.withColumn("used", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    totals = s.agg(F.sum("w").alias("all_w"), (F.sum("size") * F.lit(float(budget_ratio))).alias("budget"))
    s = s.crossJoin(F.broadcast(totals))  # one row
    # the level that holds if exactly the sources before this one are saturated
    s = s.withColumn("water", (F.col("budget") - F.col("full")) / (F.col("all_w") - F.col("used")))
    fits = s.where((F.col("w") > 0) & (F.col("water") <= F.col("level"))).agg(F.max("water").alias("found"))
    got = F.when(F.col("w") > 0, F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("found")), F.col("cap"))).otherwise(F.lit(0.0))
    return s.crossJoin(F.broadcast(fits)).select("src", "size", "weight", (got / F.col("size")).alias("epochs"))


def source_sizes(docs: DataFrame, weights: DataFrame | None = None, wanted: dict[str, float] | None = None) -> DataFrame:
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    by = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("src")).agg(F.sum(size).alias("size"))
    if weights is None:
        times = F.lit(1.0)
        for source, x in (wanted or {}).items():
            times = F.when(F.col("src") == source, F.lit(float(x))).otherwise(times)
        return by.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)) * times)
    return by.join(weights.select(F.coalesce(F.col("source"), F.lit("(none)")).alias("src"), F.col("weight").cast("double").alias("weight")), "src", "left")


def mixed(docs: DataFrame, weights: DataFrame | None = None, budget_ratio: float = 1.0, max_epochs: float = MAX_EPOCHS, wanted: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it was drawn, with ``__epochs`` and ``__copy`` (from 0)."""
    plan = written(epochs(source_sizes(docs, weights, wanted), budget_ratio, max_epochs).select(F.col("src").alias("__src"), F.col("epochs").alias("__epochs")), "epochs")
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    df = docs.withColumn("__src", F.coalesce(F.col("source").cast("string"), F.lit("(none)"))).join(small(plan), "__src", "inner")
    times = (F.floor("__epochs") + (u < F.col("__epochs") - F.floor("__epochs")).cast("long")).cast("int")
    df = df.withColumn("__times", times).where("__times > 0")
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__src", "__times")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The query's result: a row for each draw."""
    return mixed(narrowed(docs, "doc_id", "text", "source"), wanted=WANTED).select("doc_id", "source", F.round("__epochs", 6).alias("epochs"), F.col("__copy").alias("copy"))


@guarded
def mix_stage(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the drawn rows with their own columns."""
    return mixed(docs).select(*(f"`{c}`" for c in docs.columns))


SQL = f"""
WITH d AS (SELECT doc_id, text, source, coalesce(source, '(none)') AS src FROM documents),
sizes AS (SELECT src, sum(coalesce(length(text), 0)) AS size FROM d GROUP BY src),
s AS (SELECT src, size::DOUBLE AS size, pow(size::DOUBLE, {TEMPERATURE}) * CASE src {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WANTED.items())} ELSE 1 END AS w, size * {MAX_EPOCHS}::DOUBLE AS cap FROM sizes WHERE size > 0),
o AS (SELECT *, cap / w AS level, coalesce(sum(cap) OVER b, 0) AS full_, coalesce(sum(w) OVER b, 0) AS used FROM s
  WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(w) AS all_w, sum(size) AS budget FROM s),
f AS (SELECT max((budget - full_) / (all_w - used)) AS found FROM o, t WHERE (budget - full_) / (all_w - used) <= level),
e AS (SELECT src, coalesce(least(cap, w * found), cap) / size AS epochs FROM o, f),
x AS (SELECT doc_id, source, epochs, floor(epochs) + (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0 < epochs - floor(epochs))::INT AS times FROM d JOIN e USING (src))
SELECT doc_id, source, round(epochs, 6) AS epochs, unnest(range(0, times::BIGINT))::INT AS copy FROM x WHERE times > 0"""
