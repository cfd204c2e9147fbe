"""The registry of queries and of the SQL that each must agree with.

``documents`` stand for text files, ``embeddings`` for chunks that are embedded already (``label`` is their file), ``events`` for a feed
of modification times.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.functions import vectors as vx
from cairn.functions.chunkers import line_chunks, recursive_chunks
from cairn.functions.embedders import hashed
from cairn.operators import evaluate as ev
from cairn.operators import maintain as mt
from cairn.operators import search as se
from cairn.operators.render import match_tokens
from cairn.sources.shared import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark: SparkSession, sf: str, below: int) -> dict[int, list[float]]:
    """The query vectors: the first few rows by id."""
    rows = _table(spark, sf, "embeddings").where(F.col("vec_id") < below).select("vec_id", "embedding").collect()
    return {r.vec_id: list(r.embedding) for r in rows}


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``id, file_path, embedding``: a file for each label."""
    path = F.concat(F.when(F.col("label") % 2 == 0, "docs/file").otherwise("src/file"), F.col("label").cast("string"), F.when(F.col("label") % 3 == 0, ".md").otherwise(".txt"))
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), path.alias("file_path"), "embedding")


_PATH = "(CASE WHEN label % 2 = 0 THEN 'docs/file' ELSE 'src/file' END) || label || (CASE WHEN label % 3 = 0 THEN '.md' ELSE '.txt' END)"
_DIST = "1 - list_cosine_similarity(c.embedding::DOUBLE[], q.v)"
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_CHUNKS = f"c AS (SELECT vec_id AS id, {_PATH} AS file_path, embedding FROM embeddings)"
_MATCHES = "string_agg(id || ':' || printf('%.6f', d), ',' ORDER BY d, id)"


def _flat(groups: DataFrame) -> DataFrame:
    """Groups with their matches as one string, so that results can be compared."""
    m = F.array_join(F.transform("matches", lambda x: F.format_string("%d:%.6f", x["id"], x["distance"])), ",")
    return groups.select("file_path", F.round("best_score", 6).alias("best_score"), F.size("matches").cast("long").alias("n_matches"), m.alias("matches"))


# search ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_Q0} SELECT vec_id, label, round({_DIST}, 6) AS distance FROM embeddings c, q ORDER BY {_DIST}, vec_id LIMIT 30")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = se.top_k(_table(spark, sf, "embeddings"), _vectors(spark, sf, 1), 30, "vec_id")
    return hits.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q0} SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings c, q")
def cosine_scan_native(spark: SparkSession, sf: str) -> DataFrame:
    """All distances by Column expressions alone."""
    q = F.array(*(F.lit(float(x)) for x in _vectors(spark, sf, 1)[0]))
    return _table(spark, sf, "embeddings").select("vec_id", F.round(vx.cosine_distance(F.col("embedding"), q), 6).alias("distance"))


@query(f"""WITH {_Q0}, {_CHUNKS}, h AS (SELECT id, file_path, {_DIST} AS d FROM c, q ORDER BY 3, 1 LIMIT 30)
SELECT file_path, round(greatest(0, max(1 - d)), 6) AS best_score, count(*) AS n_matches, {_MATCHES} AS matches FROM h GROUP BY file_path ORDER BY max(1 - d) DESC, file_path LIMIT 10""")
def search_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(se.search(_chunks(spark, sf), _vectors(spark, sf, 1)[0], 10))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8),
d AS (SELECT query_id, c.vec_id, 1 - list_cosine_similarity(c.embedding::DOUBLE[], q.v) AS d FROM embeddings c, q)
SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) WHERE rank <= 10""")
def search_multi_query_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = se.top_k(_table(spark, sf, "embeddings").select("vec_id", "embedding"), _vectors(spark, sf, 8), 10, "vec_id")
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _lines_of(chunks: DataFrame) -> DataFrame:
    """A length for every file whose number of chunks is even; unknown for the others."""
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).select("file_path", F.when(F.col("n") % 2 == 0, F.col("n")).alias("line_page_count"))


_META = "m AS (SELECT file_path, CASE WHEN count(*) % 2 = 0 THEN count(*) END AS line_page_count FROM c GROUP BY file_path)"
_ALL = f"h AS (SELECT id, file_path, {_DIST} AS d FROM c, q)"
_TOP5 = f"SELECT file_path, round(greatest(0, max(1 - d)), 6) AS best_score, count(*) AS n_matches, {_MATCHES} AS matches FROM h {{}} GROUP BY file_path ORDER BY max(1 - d) DESC, file_path LIMIT 5"


@query(f"WITH {_Q0}, {_CHUNKS}, {_ALL} {_TOP5.format(chr(39).join(['WHERE regexp_matches(file_path, ', 'file[0-6][.]md$', ')']))}")
def search_glob(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(se.search(_chunks(spark, sf), _vectors(spark, sf, 1)[0], 5, glob="file[0-6].md"))


@query(f"WITH {_Q0}, {_CHUNKS}, {_META}, {_ALL} {_TOP5.format('JOIN m USING (file_path) WHERE line_page_count >= 40')}")
def search_min_lines(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return _flat(se.search(chunks, _vectors(spark, sf, 1)[0], 5, _lines_of(chunks), min_lines=40))


@query(f"WITH {_Q0}, {_CHUNKS}, {_ALL} {_TOP5.format('')}")
def search_filtered_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(se.search(_chunks(spark, sf), _vectors(spark, sf, 1)[0], 5, glob="*"))


@query(f"""WITH {_Q0}, {_CHUNKS}, {_META}, o AS (SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY id) AS ordinal FROM c),
h AS (SELECT id, file_path, {_DIST} AS d FROM c, q ORDER BY 3, 1 LIMIT 12), g AS (SELECT file_path, round(greatest(0, max(1 - d)), 6) AS best_score, string_agg(ordinal::VARCHAR, ',' ORDER BY d, id) AS ordinals FROM h JOIN o USING (id) GROUP BY 1)
SELECT g.*, line_page_count FROM g LEFT JOIN m USING (file_path)""")
def search_with_metadata_and_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    found = se.search(chunks, _vectors(spark, sf, 1)[0], 20, _lines_of(chunks), pool=12, with_ordinals=True)
    return found.select("file_path", F.round("best_score", 6).alias("best_score"), F.array_join(F.transform("matches", lambda m: m["ordinal"].cast("string")), ",").alias("ordinals"), "line_page_count")


@query(f"WITH {_CHUNKS} SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY id) AS ordinal FROM c")
def chunk_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return se.ordinals(_chunks(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"WITH {_CHUNKS} SELECT id, file_path, 7 AS ordinal, 0.0::DOUBLE AS distance FROM c WHERE file_path = 'src/file3.md' ORDER BY id LIMIT 1 OFFSET 6")
def chunk_fetch_nth(spark: SparkSession, sf: str) -> DataFrame:
    return se.fetch_nth(_chunks(spark, sf), "src/file3.md", 7).select("id", "file_path", "ordinal", "distance")


@query(f"WITH {_CHUNKS} SELECT file_path, count(*) AS n FROM c GROUP BY file_path")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE file_path = 'docs/file2.txt') AS chunks_of_one FROM c")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.count_if(F.col("file_path") == "docs/file2.txt").alias("chunks_of_one"))


# vectors --------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t)
SELECT vec_id, round(n, 6) AS norm, round(sqrt(list_sum(list_transform(v, lambda x: x * x / CASE WHEN n > 0 THEN n * n ELSE 1 END))), 6) AS after, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first FROM n""")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 7))
    t = _table(spark, sf, "embeddings").select("vec_id", v.alias("v")).withColumn("u", vx.l2_normalize(F.col("v")))
    return t.select("vec_id", F.round(vx.norm(F.col("v")), 6).alias("norm"), F.round(vx.norm(F.col("u")), 6).alias("after"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(f"WITH {_Q0} SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 0 THEN 1.0 ELSE round({_DIST}, 6) END AS distance FROM embeddings c, q WHERE vec_id % 7 <> 0")
def distance_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of another length and of norm 0 are at distance 1; rows without a vector are left out."""
    e, i = F.col("embedding"), F.col("vec_id")
    v = F.when(i % 7 == 0, F.when(i % 2 == 0, F.array().cast("array<float>"))).when(i % 3 == 0, F.slice(e, 1, 63)).when(i % 5 == 0, F.transform(e, lambda x: x * 0)).otherwise(e)
    t = _table(spark, sf, "embeddings").select("vec_id", v.alias("embedding"))
    return se.distances(t, _vectors(spark, sf, 1), None, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def blob_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "embeddings").withColumn("blob", vx.pack("embedding"))
    return t.select("vec_id", F.length("blob").cast("long").alias("bytes"), (vx.unpack("blob") == F.col("embedding")).alias("same"))


# text -----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + (CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END) END AS lines FROM documents")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", tx.count_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, substr(text, 1, 200) AS stored, replace(substr(substr(text, 1, 200), 1, 120), chr(10), ' ') AS shown FROM documents")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    p = tx.preview(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", p.alias("stored"), tx.rendered_preview(p).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(10) || chr(9))) > 0 THEN 'passage: ' || substr(trim(text, ' ' || chr(10) || chr(9)), 1, 2000) END AS input FROM documents")
def embed_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", tx.embed_input(F.col("text"), 2000, "passage: ").alias("input"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(0, len(l), 2)) AS s FROM l WHERE len(l) > 3),
c AS (SELECT doc_id, s + 1 AS line_start, least(s + 3, len(l)) AS line_end, trim(array_to_string(l[s + 1:least(s + 3, len(l))], chr(10)), ' ' || chr(10)) AS text FROM s)
SELECT doc_id, line_start::INT AS line_start, line_end::INT AS line_end, text FROM c WHERE length(text) > 0""")
def line_split_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of 3 lines with an overlap of 1; the documents have no headings."""
    t = _table(spark, sf, "documents").select("doc_id", F.explode(line_chunks(F.col("text"), 3, 1)).alias("c"))
    return t.select("doc_id", "c.line_start", "c.line_end", "c.text")


@query()
def recursive_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return recursive_chunks(_table(spark, sf, "documents"), "doc_id", "text", 1200, 240)


@query("""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents)
SELECT doc_id, length(t) AS whole_chars, length(t) > 1200 AS split, true AS none_blank FROM t WHERE length(t) > 0""")
def recursive_chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = recursive_chunks(_table(spark, sf, "documents"), "doc_id", "text", 1200, 0)
    return c.groupBy("doc_id").agg(F.max(F.when(F.col("ordinal") == 1, F.length("text"))).cast("long").alias("whole_chars"), (F.max("ordinal") > 1).alias("split"), F.bool_and(F.length("text") > 0).alias("none_blank"))


_HASH = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0)) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*) AS n FROM w GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(n * n)) AS n FROM b GROUP BY 1)"""


@query(f"WITH {_HASH} SELECT doc_id, string_agg(b.b || ':' || printf('%.6f', b.n / n.n), ',' ORDER BY b.b) AS vector FROM b JOIN n USING (doc_id) GROUP BY doc_id")
def hash_embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    v = hashed(_table(spark, sf, "documents"), "doc_id", "text").where(F.size("embedding") > 0)
    slots = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > 0)
    return v.select("doc_id", F.array_join(F.transform(slots, lambda s: F.format_string("%d:%.6f", s["i"], s["x"])), ",").alias("vector"))


@query(f"""WITH {_HASH}, v AS (SELECT doc_id, b.b, b.n / n.n AS x FROM b JOIN n USING (doc_id)), d AS (SELECT q.doc_id AS query_id, c.doc_id, round(1 - sum(q.x * c.x), 9) AS d FROM v q JOIN v c ON q.b = c.b WHERE q.doc_id < 5 GROUP BY 1, 2)
SELECT query_id, doc_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS r FROM d) WHERE r <= 10""")
def hash_search_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    q = {r.doc_id: r.embedding for r in hashed(docs.where("doc_id < 5"), "doc_id", "text").collect() if r.embedding}  # the scan takes only these
    v = hashed(docs, "doc_id", "text")
    return se.top_k(v, q, 10, "doc_id", decimals=9).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query(r"""SELECT page_id, regexp_replace(url, '^.*/', '') AS name, lower(regexp_extract(regexp_replace(url, '^.*/', ''), '^[^.].*\.([^.]+)$', 1)) AS extension, starts_with(url, 'https://blog.') AS inside FROM pages""")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, sf, "pages").select("page_id", tx.basename(u).alias("name"), F.when(tx.basename(u).startswith("."), "").otherwise(tx.extension(u)).alias("extension"), u.startswith("https://blog.").alias("inside"))


_PATHS = "p AS (SELECT doc_id, '/data/' || source || '/' || CASE doc_id % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'a/build/' ELSE '' END || 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.log' ELSE '.txt' END AS path FROM documents)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), F.when(i % 4 == 0, "build/").when(i % 4 == 1, "a/build/").otherwise(""), F.lit("f"), i.cast("string"), F.when(i % 3 == 0, ".log").otherwise(".txt"))
    return _table(spark, sf, "documents").select("doc_id", path.alias("path"))


@query(f"WITH {_PATHS} SELECT doc_id, CASE WHEN starts_with(path, '/data/src1/') THEN substr(path, 12) ELSE regexp_replace(path, '^.*/', '') END AS relative FROM p")
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", tx.relative_path(F.col("path"), "/data/src1/").alias("relative"))


@query(f"""WITH {_PATHS}, r AS (SELECT doc_id, substr(path, 7) AS path FROM p)
SELECT doc_id, path FROM r WHERE NOT (regexp_matches(path, '(^|/)build/') OR regexp_matches(path, '[.]log$') OR starts_with(path, 'src3/') OR regexp_matches(path, '(^|/)f1[0-9][^/]*$') OR path = 'src2/f2.txt')""")
def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    patterns = tx.ignore_patterns("# made\nbuild/\n\n*.log\n/src3/\n f1[0-9]* \n/src2/f2.txt\n")
    p = _paths(spark, sf).select("doc_id", F.substring("path", 7, 10_000).alias("path"))
    return p.where(~tx.is_ignored(F.col("path"), patterns))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(substr(text, 1, 60), '[^\\p{L}\\p{N}_-]', '-', 'g'), '-+', '-', 'g'), '-') AS name FROM documents")
def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", tx.sanitized_name(F.substring("text", 1, 60)).alias("name"))


_IDS = ["nomic@1200/240", "nl@2000/0", "my-alias@100/10", "a@0/0", "a@01/0", "a@10/007", "A@10/0", "a@10", "@10/0", "a b@1/0", "a@1/0 ", "a@99999999999/0"]


@query(f"""WITH i AS (SELECT doc_id, (['{"','".join(_IDS)}'])[doc_id % {len(_IDS)} + 1] AS identity FROM documents),
p AS (SELECT *, regexp_matches(identity, '^[a-z0-9-]+@[1-9][0-9]*/[0-9]+$') AS ok, regexp_extract(identity, '^(.*)@', 1) AS alias, try_cast(regexp_extract(identity, '@([0-9]+)', 1) AS INT) AS size, try_cast(regexp_extract(identity, '/([0-9]+)$', 1) AS INT) AS overlap FROM i)
SELECT doc_id, identity, coalesce(ok AND alias || '@' || size || '/' || overlap = identity, false) AS valid, CASE WHEN coalesce(ok AND alias || '@' || size || '/' || overlap = identity, false) THEN size END AS size FROM p""")
def profile_identity_parse(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _IDS)), (F.col("doc_id") % len(_IDS) + 1).cast("int")).alias("identity"))
    p = tx.parse_identity(F.col("identity"))
    return t.select("doc_id", "identity", p.isNotNull().alias("valid"), p["size"].alias("size"))


# maintenance ----------------------------------------------------------------------------------------------------------

_SCAN = "s AS (SELECT source || '/' || doc_id AS file_path, epoch_us(TIMESTAMP '2024-01-01') + n_chars * 1000000 AS m, n_chars, doc_id FROM documents WHERE doc_id % 11 <> 0)"
_INDEXED = "i AS (SELECT source || '/' || doc_id AS file_path, epoch_us(TIMESTAMP '2024-01-01') + (n_chars + doc_id % 3 - 1) * 1000000 AS m, n_chars, doc_id FROM documents WHERE doc_id % 7 <> 0)"


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("n_chars")).cast("timestamp")
    return _table(spark, sf, "documents").where("doc_id % 11 <> 0").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), at.alias("file_modified_at"), F.col("n_chars").alias("line_page_count"), "doc_id")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("n_chars") + F.col("doc_id") % 3 - 1).cast("timestamp")
    return _table(spark, sf, "documents").where("doc_id % 7 <> 0").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), at.alias("file_modified_at"), F.col("n_chars").alias("line_page_count"), "doc_id")


@query(f"WITH {_SCAN}, {_INDEXED} SELECT s.file_path, CASE WHEN i.m IS NULL THEN 'Added' WHEN s.m > i.m THEN 'Updated' ELSE 'Unchanged' END AS label FROM s LEFT JOIN i USING (file_path)")
def change_detect(spark: SparkSession, sf: str) -> DataFrame:
    return mt.detect_changes(_scan(spark, sf), _indexed(spark, sf)).select("file_path", "label")


@query(f"WITH {_SCAN}, {_INDEXED} SELECT file_path FROM i ANTI JOIN s USING (file_path)")
def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    return mt.removed_files(_scan(spark, sf), _indexed(spark, sf)).select("file_path")


@query(f"WITH {_SCAN}, {_INDEXED}, t AS (SELECT s.* FROM s LEFT JOIN i USING (file_path) WHERE i.m IS NULL OR s.m > i.m) SELECT file_path, doc_id, n_chars AS line_page_count, m // 1000000 AS modified FROM (SELECT * FROM i ANTI JOIN t USING (file_path) UNION ALL SELECT * FROM t)")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    idx = _indexed(spark, sf)
    new = mt.detect_changes(_scan(spark, sf), idx).where("label <> 'Unchanged'").drop("label")
    return mt.upserted(idx, new).select("file_path", "doc_id", "line_page_count", F.col("file_modified_at").cast("long").alias("modified"))


@query(f"WITH {_CHUNKS} SELECT id, file_path FROM c WHERE file_path <> 'docs/file4.txt'")
def remove_path(spark: SparkSession, sf: str) -> DataFrame:
    return mt.removed(_chunks(spark, sf), "docs/file4.txt").select("id", "file_path")


@query(f"WITH {_CHUNKS}, t AS (SELECT DISTINCT file_path FROM c WHERE id % 50 = 1) SELECT id, file_path, false AS fresh FROM c ANTI JOIN t USING (file_path) UNION ALL SELECT id, file_path, true FROM c SEMI JOIN t USING (file_path) WHERE id % 2 = 0")
def partial_reindex(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).select("id", "file_path").withColumn("fresh", F.lit(False))
    touched = c.where("id % 50 = 1")
    new = c.join(touched.select("file_path").distinct(), "file_path", "left_semi").where("id % 2 = 0").withColumn("fresh", F.lit(True))
    return mt.replaced(c, new, touched).select("id", "file_path", "fresh")


_OUT = """f AS (SELECT conv_id::VARCHAR AS file_path, count(*) AS total, count(*) FILTER (WHERE (turn * 7 + conv_id) % 5 < conv_id % 6) AS ok, CASE WHEN conv_id % 2 = 0 THEN 'Added' ELSE 'Updated' END AS label FROM conversations GROUP BY conv_id),
o AS (SELECT *, CASE WHEN ok > 0 THEN 'indexed' WHEN total > 0 THEN 'skippedEmbedFailure' ELSE 'skippedUnreadable' END AS outcome FROM f)"""


def _barrier(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("ordinal"), F.when((F.col("turn") * 7 + F.col("conv_id")) % 5 < F.col("conv_id") % 6, F.array(F.lit(1.0))).alias("embedding"))
    return mt.complete_files(c, c.groupBy("file_path").agg(F.count(F.lit(1)).alias("total")))


@query("""SELECT conv_id::VARCHAR AS file_path, count(*) AS total, count(*) - count(*) FILTER (WHERE (turn * 7 + conv_id) % 5 < conv_id % 6) AS failed, true AS complete,
coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE (turn * 7 + conv_id) % 5 < conv_id % 6), '') AS ordinals FROM conversations GROUP BY conv_id""")
def completeness_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return _barrier(spark, sf).select("file_path", "total", "failed", "complete", F.array_join("ordinals", ",").alias("ordinals"))


@query(f"WITH {_OUT} SELECT count(*) FILTER (WHERE outcome = 'indexed' AND label = 'Added') AS added, count(*) FILTER (WHERE outcome = 'indexed' AND label = 'Updated') AS updated, count(*) FILTER (WHERE outcome = 'skippedUnreadable') AS skipped_unreadable, count(*) FILTER (WHERE outcome = 'skippedEmbedFailure') AS skipped_embed_failures, count(*) FILTER (WHERE outcome = 'indexed' AND ok < total) AS partial_failures, false AS all_failed FROM o")
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    f = _barrier(spark, sf)
    o = f.select("failed", mt.outcome(F.col("total"), F.col("total") - F.col("failed")).alias("outcome"), F.when(F.col("file_path").cast("long") % 2 == 0, "Added").otherwise("Updated").alias("label"))
    return mt.all_failed(mt.tally(o))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_type", F.col("event_id").cast("string").alias("file_path"), F.col("value").alias("seconds"), (F.col("user_id") % 4).alias("chunks"))


@query("SELECT event_type, round(sum(value), 4) AS total_seconds, round(quantile_cont(value, 0.5) FILTER (WHERE user_id % 4 > 0), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE user_id % 4 > 0), 6) AS p95, sum(user_id % 4)::BIGINT AS chunks, max(user_id % 4) AS most_chunks FROM events GROUP BY event_type")
def stage_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    t = mt.timings(_timed(spark, sf), ["event_type"])
    return t.withColumns({"total_seconds": F.round("total_seconds", 4), "p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("SELECT event_id::VARCHAR AS file_path, value AS seconds FROM events ORDER BY value DESC, event_id::VARCHAR LIMIT 5")
def slowest_files(spark: SparkSession, sf: str) -> DataFrame:
    return mt.slowest(_timed(spark, sf)).select("file_path", "seconds")


@query("SELECT time_bucket(INTERVAL 30 SECONDS, ts::TIMESTAMP) AS at, count(*) AS files, round(count(*) / 30.0, 6) AS per_second FROM events GROUP BY 1")
def throughput_window(spark: SparkSession, sf: str) -> DataFrame:
    w = _table(spark, sf, "events").groupBy(F.window("ts", "30 seconds").alias("w")).agg(F.count(F.lit(1)).alias("files"))
    return w.select(F.col("w.start").alias("at"), "files", F.round(F.col("files") / 30.0, 6).alias("per_second"))


@query("SELECT event_id, CASE WHEN user_id % 20 > 8 THEN 'db' WHEN event_id % 10 >= 8 THEN 'embed' WHEN user_id % 3 > 0 AND event_id % 10 = 0 THEN 'extract' ELSE 'ok' END AS state FROM events")
def bottleneck_states(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return _table(spark, sf, "events").select("event_id", tx.bottleneck(u % 20, u % 3, e % 10, F.lit(8)).alias("state"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_retention_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return mt.last_n(_table(spark, sf, "events"), 200, ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT source, lang, count(*) AS stores, CASE count(*) WHEN 0 THEN 'none' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS resolution FROM documents WHERE doc_id % 17 = 0 GROUP BY 1, 2")
def config_dir_resolution(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    t = _table(spark, sf, "documents").where("doc_id % 17 = 0").groupBy("source", "lang")
    return t.agg(n.alias("stores")).withColumn("resolution", F.when(F.col("stores") == 0, "none").when(F.col("stores") == 1, "ok").otherwise("ambiguous"))


# evaluation -----------------------------------------------------------------------------------------------------------

_RUBRIC = ev.Rubric(("docs/file0.md", "src/file1.txt"))
_RANKS = f"""qs AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 10), {_CHUNKS},
d AS (SELECT query, id, file_path, 1 - list_cosine_similarity(c.embedding::DOUBLE[], v) AS d FROM c, qs), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS r FROM d) WHERE r <= 60),
g AS (SELECT query, file_path, row_number() OVER (PARTITION BY query ORDER BY greatest(0, max(1 - d)) DESC, file_path) AS rank FROM h GROUP BY query, file_path),
t AS (SELECT * FROM (VALUES ('docs/file0.md'), ('src/file1.txt')) t(target)), k AS (SELECT qs.query, target, (SELECT min(rank) FROM g WHERE g.query = qs.query AND file_path = target AND rank <= 20) AS rank FROM qs, t),
p AS (SELECT *, CASE WHEN rank <= 3 THEN 3 WHEN rank <= 10 THEN 2 WHEN rank <= 20 THEN 1 ELSE 0 END AS points FROM k)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """The rubric's pool: 60 chunks, 20 files."""
    hits = se.top_k(_chunks(spark, sf), _vectors(spark, sf, 10), 60)
    files = hits.groupBy("query_id", "file_path").agg(F.greatest(F.lit(0.0), F.max(1 - F.col("distance"))).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "file_path")
    results = files.select(F.lit(0).alias("point"), F.col("query_id").alias("query"), F.row_number().over(w).alias("rank"), F.col("file_path").alias("file")).where("rank <= 20")
    targets = spark.createDataFrame([(t, t) for t in _RUBRIC.targets], "target string, file string")
    return ev.points(ev.target_ranks(results, targets), _RUBRIC)


@query(f"WITH {_RANKS} SELECT query, target, rank, points FROM p")
def rubric_rank_points(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("query", "target", F.col("rank").cast("long").alias("rank"), "points")


@query(f"WITH {_RANKS}, b AS (SELECT query, sum(points) AS p, max(coalesce(rank <= 10, false)::INT) AS e, min(coalesce(rank <= 10, false)::INT) AS b FROM p GROUP BY query) SELECT sum(p)::BIGINT AS total, sum(e)::BIGINT AS either, sum(b)::BIGINT AS both FROM b")
def rubric_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ev.totals(_scored(spark, sf), _RUBRIC).select("total", "either", "both")


_GRID = "g AS (SELECT min(o) AS ordinal, size, overlap FROM (SELECT (i - 1) * 3 + j - 1 AS o, ([800, 1200, 800, 1250])[i] AS size, round(([800, 1200, 800, 1250])[i] * ([0, 20, 33])[j] / 100.0)::INT AS overlap FROM range(1, 5) a(i), range(1, 4) b(j)) GROUP BY size, overlap)"


@query(f"WITH {_GRID} SELECT ordinal::BIGINT AS ordinal, size, overlap FROM g")
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    return ev.grid(spark, ev.parse_ints("800, 1200,,800,1250"), [0, 20, 33]).select(F.col("ordinal").cast("long").alias("ordinal"), "size", "overlap")


@query(f"""WITH {_GRID}, t AS (SELECT g.*, (SELECT count(*) FROM documents WHERE n_chars > size - overlap AND n_chars % 3 = ordinal % 3) AS total FROM g)
SELECT ordinal::BIGINT AS ordinal, size, overlap, total FROM t ORDER BY total DESC, ordinal LIMIT 1""")
def sweep_best(spark: SparkSession, sf: str) -> DataFrame:
    g = ev.grid(spark, [800, 1200, 800, 1250], [0, 20, 33])
    d = _table(spark, sf, "documents").select("n_chars")
    t = g.join(d, (F.col("n_chars") > F.col("size") - F.col("overlap")) & (F.col("n_chars") % 3 == F.col("ordinal") % 3), "left").groupBy("ordinal", "size", "overlap").agg(F.count("n_chars").alias("total"))
    return ev.best_point(t).select(F.col("ordinal").cast("long").alias("ordinal"), "size", "overlap", "total")


# rendering and streams ------------------------------------------------------------------------------------------------


@query(f"""WITH {_Q0}, {_CHUNKS}, h AS (SELECT id, file_path, {_DIST} AS d FROM c, q ORDER BY 3, 1 LIMIT 15),
m AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY d, id) AS n FROM h)
SELECT file_path, string_agg(CASE id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'P' || id ELSE CASE WHEN prev >= 2 THEN '' ELSE 'L' END || id || '-' || (id + 3) END, ',' ORDER BY n) AS tokens
FROM (SELECT *, lag(id % 4) OVER (PARTITION BY file_path ORDER BY n) AS prev FROM m) GROUP BY file_path""")
def match_list_tokens(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    c = _chunks(spark, sf).withColumns({"chunk_type": F.when(i % 4 == 0, "whole").when(i % 4 == 1, "pdf_page").otherwise("chunk"), "page_number": i.cast("int"), "line_start": i.cast("int"), "line_end": (i + 3).cast("int")})
    found = se.coalesced(se.top_k(c, _vectors(spark, sf, 1), 15), None, match=["chunk_type", "page_number", "line_start", "line_end"])
    return found.select("file_path", match_tokens(F.col("matches")).alias("tokens"))


@query()
def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arriving as files in two steps, kept in an index by upserts; the index as it is in the end."""
    from cairn.streaming.incremental import demo

    return demo(spark, sf)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_rates_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rates by a stream with a watermark, to its end."""
    from cairn.streaming.incremental import rates

    return rates(spark, f"{sf}/events.parquet")


@query()
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A store is made, updated twice, searched and described."""
    from cairn.store import VectorStore

    home = scratch(spark, "stores")
    store = VectorStore.create(spark, home, "demo", "/data")
    docs = _table(spark, sf, "documents").where("doc_id < 60")
    files = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), F.lit("2024-01-01").cast("timestamp").alias("file_modified_at"), F.col("text").cast("binary").alias("content"))
    store.update(files.where("file_path not like 'src1/%'"), alias="hashing")
    store.update(files.withColumn("file_modified_at", F.when(F.col("file_path").like("src2/%"), F.lit("2024-02-01").cast("timestamp")).otherwise(F.col("file_modified_at"))), alias="hashing")
    return store.search("the and of", limit=5, with_metadata=True).select("file_path", F.round("best_score", 6).alias("best_score"), "line_page_count", F.lit(json.dumps(store.describe())).alias("about"))
