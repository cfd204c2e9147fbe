"""Connected components by alternating large and small stars, each round a written table; the rows of joins that give a row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Edges ``a, b`` with ``b < a``: each node's larger (or smaller) neighbours are hung on its least."""
    if small:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # counted on the map side first and joined back, where a node of very many neighbours may be split
    hung = pairs.join(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")
    if small:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``node, component`` (the least node) for every node on an edge between two nodes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, before = written(e, "edges"), None
    while True:
        e = written(_stars(written(_stars(e, small=False), "stars"), small=True), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Of a node: documents that some of its answers link it to, the least node of them or of a chain of them, and whether no other row leads further.
TALLIES = "fp long, links long, root long, whole boolean"


def weighed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(fp, id, key)``, the documents that are copies of node ``fp``, without repeated rows; and of each node their number ``n`` and ``least`` id."""
    members = written(members.distinct(), "members")
    return members, written(members.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "weights")


def link_classes(every: DataFrame, members: DataFrame, weights: DataFrame, tallies: DataFrame) -> DataFrame:
    """``id, class_id, n_links`` of each distinct row of ``every(id, key)`` with an id, from ``tallies`` of the nodes; copies link to each other."""
    by_node = tallies.groupBy("fp").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    classes = weights.join(by_node, "fp", "left")
    across = tallies.where("not whole and fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    if across.limit(1).count():
        classes = classes.join(components(across), F.col("fp") == F.col("node"), "left")
        classes = classes.withColumn("root", F.coalesce("component", "root"))
    classes = written(classes.select("fp", F.coalesce("root", "fp").alias("class"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes")
    least = classes.groupBy("class").agg(F.min("least").alias("class_id"))
    found = written(members.join(small(written(classes.join(least, "class").select("fp", "class_id", "n_links"), "verdicts")), "fp").drop("fp"), "found")
    joined = every.where("id is not null").distinct().join(small(found), ["id", "key"], "left")
    return joined.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def link_classes_sql(name: str) -> str:
    """The end of a recursive query that has the documents ``d(d, name)``, numbered in the order of their ids, and the pairs ``p(a, b)``."""
    return f"""l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT d, d AS least FROM d UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.d WHERE r.least < l.b),
c AS (SELECT d, min(least) AS least FROM r GROUP BY d),
n AS (SELECT a AS d, count(*) AS n FROM l GROUP BY a)
SELECT d.{name}, first.{name} AS class_id, coalesce(n.n, 0) AS n_links FROM d JOIN c ON c.d = d.d JOIN d first ON first.d = c.least LEFT JOIN n ON n.d = d.d"""
