"""Operator 4. Repeated passages by compacting the repeated edges of a de Bruijn graph of words.

The graph's edges are the runs of ``K`` words (lower case, punctuation left out), its nodes the runs of
``K - 1`` between them; an edge that occurs twice or more, in whatever places, is repeated. A node is nonbranching if all occurrences of the
edge into it are followed by one edge, and all occurrences of that one are preceded by the first; the end of a text counts as a branch.

1. *Anchors.* In every window of ``K - M + 1`` the ``M``-word run of the least hash is an anchor, so each edge
   has an anchor that is decided by the edge's words alone. Only edges whose anchor occurs at least twice can be repeated; the
   others, nearly all, are never shuffled.
2. *Runs.* What is left travels as runs of edges that share an anchor, not edge by edge. Equal runs between equal neighbours are counted, on the map side
   first, so a passage of a million documents reaches the graph as a few rows.
3. *Compaction.* All occurrences of an edge have its anchor, so one group of anchors counts its edges, sees which nodes branch and compacts what lies
   within it. These pieces are glued to paths by joins of a piece's end with the next one's beginning and pointer doubling: a piece finds its path's head in
   as many rounds as the path's number of pieces has bits.
4. *Sources.* Since no node of a path branches, a path occurs as a whole wherever its first edge does. The paths therefore go back, by the anchor of their first edge, to the texts
   that hold it, and nothing else does.
5. *Verification.* There the words from the source coordinates of the first edge to those of the last are read from the text and digested (128 bits).
   Only occurrences of a path that agree with another one on the words count.
6. *Spans.* Adjacent and overlapping verified paths of a text make one span.

Texts that are equal are walked once and counted as often as they occur.

Defined results: null and short texts have no span; an edge that is repeated within one text counts; repeated rows count as
separate sources but rows of the same id and text give their spans once each; null ids pass and come last among sources. Ties of
the first place go to the least id, then the text's hash, then the place. Extra columns are ignored; an empty table gives no spans. A very long text is
walked whole, in one piece of its own; its cut and its spans are those of any text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import buckets_of, guarded, narrowed, small, written
from cairn.llm.text import WORD_PATTERN, Words, pieces, ranges_hash, released

#: Words of an edge: the shortest passage found.
K = 50
#: Words of an anchor.
M = 16
#: A run has at most so many edges (that of a text that repeats one word would be as long as the text).
RUN = 64


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``w`` neighbours, by doubling."""
    f, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= w:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def _anchors(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (words of the batch) and hashes of the anchors of all windows that lie inside a document."""
    n, wide = len(w.hash), k - m + 1
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = w.document()
    at = np.arange(n - m + 1)
    g = ranges_hash(w.hash, at, at + m)
    low = _slide(g, wide, True)
    inside = doc[: n - k + 1] == doc[k - 1 :]
    low = np.where(inside, low, 0)  # no hash is as low, so no place is chosen for it
    pad = np.zeros(wide - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), wide, False) == g)
    # a place may equal the least of a window of another document: it must lie in one of its own
    d = doc[chosen]
    chosen = chosen[(w.first[d + 1] - w.first[d] >= k) & (chosen + m <= w.first[d + 1])]
    return chosen, g[chosen]


def _emit_anchors(k: int, m: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in pieces(batch, 1):
                w = Words(texts)
                at, h = _anchors(w, k, m)
                d = w.document()[at] if len(at) else at
                # in a document an anchor counts as often as it occurs there, up to twice
                pair, n = np.unique(np.stack([np.array(keys, np.int64)[d], h.view(np.int64)]), axis=1, return_counts=True) if len(at) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.minimum(n, 2).astype(np.int32))], ["text_key", "anchor", "n"])

    return run


def _edges(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the hash of the edge that begins there, 0 where none does; and its document."""
    doc = w.document()
    edge = np.zeros(len(w.hash), np.uint64)
    if len(edge) >= k:
        at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        edge[at] = ranges_hash(w.hash, at, at + k)
    return edge, doc


_RUNS = "anchor long, digest long, prev long, next long, text_key long, pos long, copies long, run binary"


def _emit_runs(k: int, m: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts, known, rows in pieces(batch, 1):
                w = Words(texts)
                if len(w.hash) < k:
                    continue
                edge, doc = _edges(w, k)
                low = _slide(ranges_hash(w.hash, (at := np.arange(len(w.hash) - m + 1)), at + m), k - m + 1, True)
                # that a hash is repeated holds for the whole corpus, so the batch's lists may be put together
                often = np.unique(np.concatenate([np.asarray(a, np.int64) for a in known])).view(np.uint64)
                at = np.flatnonzero((edge[: len(low)] != 0) & np.isin(low, often))
                if not len(at):
                    continue
                new = np.concatenate([[True], (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])
                first = np.flatnonzero(new)
                new |= (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % RUN == 0
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))
                own, of = edge[at], doc[at[first]]
                begin, end = at[first], at[last - 1]
                prev = np.where((begin > 0) & (doc[begin - 1] == of), edge[begin - 1], 0)
                after = np.minimum(end + 1, len(doc) - 1)
                nxt = np.where((end + 1 < len(doc)) & (doc[after] == of), edge[after], 0)
                runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(first, len(at)) * 8).astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(x.view(np.int64)) for x in (low[begin], ranges_hash(own, first, last), prev.astype(np.uint64), nxt.astype(np.uint64))),
                    pa.array(np.array(keys, np.int64)[of]), pa.array((begin - w.first[of]).astype(np.int64)), pa.array(np.array(rows, np.int64)[of]), runs,
                ], [c.split()[0] for c in _RUNS.split(", ")])

    return run


_PIECE = "head long, anchor long, tail long, n long, up long, down long"


@released
def _compact(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a group of anchors: the repeated edges, those between nonbranching nodes as one piece, with the edges it may be glued to (or 0)."""
    col = lambda c: rows.column(c).to_numpy()
    data = rows.column("run").to_pylist()
    size = np.array([len(x) // 8 for x in data])
    edge, end = np.frombuffer(b"".join(data), np.uint64), np.cumsum(size)
    del data
    nxt, prv = np.append(edge[1:], np.uint64(0)), np.append(np.uint64(0), edge[:-1])
    nxt[end - 1], prv[end - size] = col("next").view(np.uint64), col("prev").view(np.uint64)
    text, pos = np.repeat(col("text_key"), size), np.repeat(col("pos") - (end - size), size) + np.arange(len(edge))
    order = np.lexsort((pos, text, edge))
    e = edge[order]
    start = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    copies = np.add.reduceat(np.repeat(col("copies"), size)[order], start)
    keep = copies > 1
    if not keep.any():
        return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in _PIECE.split(", ")})

    def only(x: np.ndarray) -> np.ndarray:
        """The one neighbour of each edge, or 0."""
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        return np.where(low == high, low, 0)[keep]

    nxt, prv, least = only(nxt[order]), only(prv[order]), order[start][keep]
    # all occurrences of edges between nonbranching nodes are side by side, so their least places are
    e, text, pos, anchor = edge[least], text[least], pos[least], np.repeat(col("anchor"), size)[least]
    order = np.lexsort((pos, text))
    e, nxt, prv, text, pos, anchor = (x[order] for x in (e, nxt, prv, text, pos, anchor))
    glued = (text[1:] == text[:-1]) & (pos[1:] == pos[:-1] + 1) & (nxt[:-1] == e[1:]) & (prv[1:] == e[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~glued]))
    last = np.append(first[1:], len(e)) - 1
    out = (e[first], anchor[first], e[last], (last - first + 1).astype(np.int64), prv[first], nxt[last])
    return pa.table({c.split()[0]: pa.array(x.view(np.int64)) for c, x in zip(_PIECE.split(", "), out, strict=True)})


def pieces_of_paths(runs: DataFrame, buckets: int) -> DataFrame:
    """``head, anchor, tail, n, up, down``: the compacted pieces of each group of anchors."""
    place = F.struct("text_key", "pos")
    equal = runs.groupBy("anchor", "digest", "prev", "next").agg(F.sum("copies").alias("copies"), F.min(place).alias("place"), F.first("run").alias("run"))
    equal = equal.select("anchor", "prev", "next", "copies", "place.text_key", "place.pos", "run")
    return equal.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInArrow(_compact, _PIECE)


def compacted(found: DataFrame) -> DataFrame:
    """``path, anchor, edges``: the nonbranching paths, by their first edge, glued from pieces by pointer doubling.

    No path is a circle: the last occurrence of its edges in a text would have to be followed by another.
    """
    p = found.select("head", "tail", "n", "up", "down")
    before = p.where("down <> 0").select(F.col("down").alias("head"), F.col("tail").alias("up"), F.col("head").alias("path"))
    jump = written(p.where("up <> 0").select("head", "up").join(before, ["head", "up"]).select("head", "path"), "links")
    moved = bool(jump.limit(1).count())
    while moved:
        far = jump.select(F.col("head").alias("path"), F.col("path").alias("far"))
        jump = written(jump.join(small(far), "path", "left").select("head", F.coalesce("far", "path").alias("path"), F.col("far").isNotNull().alias("moved")), "paths")
        moved = bool(jump.where("moved").limit(1).count())
        jump = jump.select("head", "path")
    of = found.select("head", "anchor", "n").join(small(jump), "head", "left").withColumn("path", F.coalesce("path", "head"))
    return of.groupBy("path").agg(F.max(F.when(F.col("path") == F.col("head"), F.col("anchor"))).alias("anchor"), F.sum("n").alias("edges"))


_PLACE = "path long, edges int, high long, low long, text_key long, pos int, begin int, finish int, rows long, first_id long"


def _emit_places(k: int):
    """The occurrences of the paths whose first edge may be in a text, with a digest of the words at their coordinates."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts, paths, rows, firsts in pieces(batch, 1):
                w = Words(texts)
                edge, doc = _edges(w, k)
                wanted = np.array([(x["path"], x["edges"]) for own in paths for x in own], np.int64).reshape(-1, 2)
                path, one = np.unique(wanted[:, 0].view(np.uint64), return_index=True)
                at = np.flatnonzero(np.isin(edge, path) & (edge != 0))
                n = wanted[one, 1][np.searchsorted(path, edge[at])]
                # a path that runs out of the text is no occurrence: only edges whose hashes collide come to that
                fits = at + n + k - 1 <= w.first[doc[at] + 1]
                at, n = at[fits], n[fits]
                if not len(at):
                    continue
                d, last = doc[at], at + n + k - 2
                begin, finish = w.start[at], w.end[last]
                said = w.plain()
                digest = np.frombuffer(b"".join(hashlib.blake2b(said[a:b], digest_size=16).digest() for a, b in zip(w.plain_start[at].tolist(), (w.plain_start[last] + w.end[last] - w.start[last]).tolist(), strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(edge[at].view(np.int64)), pa.array(n.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.array(keys, np.int64)[d]), pa.array((at - w.first[d]).astype(np.int32)),
                    pa.array(w.characters(begin, d).astype(np.int32)), pa.array(w.characters(finish, d).astype(np.int32)), pa.array(rows, pa.int64()).take(pa.array(d)), pa.array(firsts, pa.int64()).take(pa.array(d)),
                ], [c.split()[0] for c in _PLACE.split(", ")])

    return run


def text_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """A written table of verified path occurrences: ``text_key, pos, edges, begin, finish, copies, first, path``."""
    buckets = buckets_of(docs)
    # fewer characters cannot hold k words
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).where(F.length("text") >= 2 * k - 1)
    anchors = written(d.select("text_key", "text").mapInArrow(_emit_anchors(k, m), "text_key long, anchor long, n int").groupBy("text_key", "anchor").agg(F.sum("n").alias("n")), "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1").select("anchor")
    held = written(anchors.select("text_key", "anchor").join(often, "anchor", "left_semi"), "repeated-anchors")
    by_text = written(held.groupBy("text_key").agg(F.collect_list("anchor").alias("anchors")), "texts")
    texts = d.join(small(by_text), "text_key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("anchors").alias("anchors"), F.count(F.lit(1)).alias("rows"))
    found = written(pieces_of_paths(texts.mapInArrow(_emit_runs(k, m), _RUNS), buckets), "pieces")
    paths = written(compacted(found), "compacted")
    by_text = held.join(small(paths), "anchor").groupBy("text_key").agg(F.collect_list(F.struct("path", "edges")).alias("paths"))
    by_text = written(by_text, "paths-of-texts")
    texts = d.join(small(by_text), "text_key").groupBy("text_key").agg(F.first("text").alias("text"), F.first("paths").alias("paths"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"))
    places = written(texts.mapInArrow(_emit_places(k), _PLACE), "places")
    place = F.struct(F.col("first_id").isNull().alias("null"), "first_id", "text_key", "pos")
    agreed = places.groupBy("path", "high", "low").agg(F.sum("rows").alias("copies"), F.min(place).alias("least")).where("copies > 1")
    agreed = written(agreed.select("path", "high", "low", "copies", F.col("least.text_key").alias("least_key"), F.col("least.pos").alias("least_pos")), "agreed")
    first = (F.col("least_key") == F.col("text_key")) & (F.col("least_pos") == F.col("pos"))
    return written(places.join(small(agreed), ["path", "high", "low"]).select("text_key", "pos", "edges", "begin", "finish", "copies", first.alias("first"), "path"), "occurrences")


def _merged(occurrences: DataFrame, k: int, only_later: bool) -> DataFrame:
    """Occurrences of a text that touch or overlap as one: ``text_key, begin, finish, word, words, copies``."""
    w = Window.partitionBy("text_key").orderBy("pos")
    o = occurrences.where("not first") if only_later else occurrences
    end = F.max(F.col("pos") + F.col("edges") + (k - 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("span", F.sum(F.when(end >= F.col("pos"), 0).otherwise(1)).over(w))
    first = F.min("pos")
    return o.groupBy("text_key", "span").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish"), first.alias("word"), (F.max(F.col("pos") + F.col("edges")) + (k - 1) - first).alias("words"), F.max("copies").alias("copies")).drop("span")


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """The query's result: ``doc_id, span_start, span_end`` (characters), ``first_word, n_words, copies`` for each longest repeated span."""
    docs = narrowed(docs, "doc_id", "text")
    found = written(_merged(text_spans(docs, k), k, only_later=False), "spans")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return mine.join(small(found), "text_key").select("doc_id", F.col("begin").alias("span_start"), F.col("finish").alias("span_end"), F.col("word").alias("first_word"), F.col("words").alias("n_words"), "copies")


@guarded
def cut_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """The pipeline's stage: every row stays; passages that have an earlier place are cut from its text, and ``n_chars`` follows.

    Of an edge's places the first stays: that of the least id. Equal texts are not cut against each other (that is
    for near-copy removal): what one of them loses, all lose. A row whose text is not cut keeps text and count as they were.
    """
    later = _merged(text_spans(docs, k), k, only_later=True)
    cuts = written(later.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("cuts")), "cuts")
    marked = docs.withColumn("__key", F.xxhash64("text")).join(small(cuts.select(F.col("text_key").alias("__key"), F.col("cuts").alias("__cuts"))), "__key", "left")
    ends = F.transform("__cuts", lambda c: c["finish"])
    starts = F.transform("__cuts", lambda c: c["begin"])
    kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.length("text"))), lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    out = marked.withColumn("__text", text)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("__text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("__cuts").isNull(), F.col(c)).otherwise(F.length("__text").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


_RUN = WORD_PATTERN.replace("a-z", "A-Za-z")
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') AS w, list_transform(regexp_extract_all(text, '[^{_RUN[1:-2]}]*{_RUN}'), lambda p: length(p)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i AS pos, array_to_string(w[i + 1:i + {K}], ' ') AS edge FROM (SELECT doc_id, w, unnest(range(0, len(w) - {K - 1})) AS i FROM w)),
r AS (SELECT doc_id, pos, copies FROM (SELECT *, count(*) OVER (PARTITION BY edge) AS copies FROM e) WHERE copies > 1),
c AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {K} >= pos THEN 0 ELSE 1 END AS cut FROM r),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM c),
f AS (SELECT doc_id, min(pos) AS first_word, max(pos) + {K} - min(pos) AS n_words, max(copies) AS copies FROM g GROUP BY doc_id, span)
SELECT doc_id, (list_sum(l[1:first_word + 1]) - length(w[first_word + 1]))::INT AS span_start, list_sum(l[1:first_word + n_words])::INT AS span_end,
  first_word::INT AS first_word, n_words::INT AS n_words, copies FROM f JOIN w USING (doc_id)"""
