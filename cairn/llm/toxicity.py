"""Operator 7. Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of the labelled documents: at most ``PER_CLASS`` toxic and as many clean
ones, those of the least seeded hash of the id. Features are words and the first ``STEM`` characters of longer words,
of these the ones whose share among toxic and clean examples differs by ``APART`` standard errors; their document frequencies are
counted over all documents. The examples' index holds, for each word, postings cut into blocks of ``WIDTH`` examples, and
each block's greatest weight. A document's bound for a block is the sum over its words of those maxima; blocks are
scored exactly in the order of their bounds until no bound reaches the ``K``-th best similarity, so the neighbours are exactly the nearest.

The vote is the toxic share of the neighbours' similarity, times ``m / (m + MASS)`` where ``m`` is the squared norm of the
document's vector, so that one weak word does not decide. It is calibrated on the examples themselves,
each left out of its own neighbours: per tenth of the vote, the odds of the two classes, smoothed, under the classes' shares
among all labels. The neighbours are the evidence.

Defined results: similarities are compared at 9 decimals, ties go to the least example id; a document is never its own neighbour;
a null, empty or wholly unknown text has no neighbour, vote 0, no evidence and is not toxic; several label rows of an id count as toxic if
one is; labels with null id or null toxicity are left out; if an id has several texts its example is the least of them; without labels of both classes nothing is toxic.
Every row of the documents gets a row, repeated ones and null ids too. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrowed
from cairn.llm.text import WORD_PATTERN, Words, pieces, ranges_hash

#: The documented bound on the sample of labelled rows.
PER_CLASS = 512
K = 15
WIDTH = 64
BINS = 10
TOXIC = 0.5
STEM, APART, MASS = 4, 3.0, 50.0
SEED = "cairn-tox-1"


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every word and stem of a batch."""
    w = Words(texts)
    doc = w.document()
    begins = (w.bytes & 0xC0) != 0x80
    count, place = np.concatenate([[0], np.cumsum(begins)]), np.flatnonzero(begins)
    long = np.flatnonzero(count[w.end] - count[w.start] > STEM)
    stem = ranges_hash(w.bytes, w.start[long], place[count[w.start[long]] + STEM]) ^ np.uint64(0x5851F42D4C957F2D)
    return np.concatenate([doc, doc[long]]), np.concatenate([w.hash, stem])


def _terms(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) of a batch, in that order, with how often each occurs."""
    doc, h = _features(texts)
    if not len(h) or not len(vocabulary):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    pair, n = np.unique((doc[hit] << 32) | at[hit], return_counts=True)
    return pair >> 32, pair & 0xFFFFFFFF, n


def selected(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that tell the classes of the examples apart."""
    bad, good = int(toxic.sum()), int((1 - toxic).sum())
    if not bad or not good:
        return np.empty(0, np.uint64)
    doc, h = _features(texts)
    once = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)
    feature, inverse = np.unique(once[0], return_inverse=True)
    a = np.bincount(inverse, toxic[once[1].astype(np.int64)], len(feature))
    b = np.bincount(inverse, minlength=len(feature)) - a
    share = (a + b) / (bad + good)
    z = (a / bad - b / good) / np.sqrt(share * (1 - share + 1e-9) * (1 / bad + 1 / good))
    return feature[np.abs(z) >= APART]


class Index:
    """Postings of the examples by (term, block), block maxima, and the search."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, k: int = K, width: int = WIDTH):
        weight = (1 + np.log(n)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weight * weight, len(ids)))
        # neighbours in the index should be alike: order by the heaviest word, which tells languages apart
        top = np.full(len(ids), -1, np.int64)
        heavy = np.lexsort((n, doc))
        top[doc[heavy]] = term[heavy]
        order = np.lexsort((ids, toxic, top))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.toxic, self.idf, self.k, self.width = ids[order], toxic[order].astype(np.float64), idf, k, width
        self.blocks = max(1, -(-len(ids) // width))
        p, value = place[doc], weight / norm[doc]
        key = term * self.blocks + p // width
        s = np.lexsort((p, key))
        self.slot, self.value = p[s] % width, value[s]
        self.ptr = np.searchsorted(key[s], np.arange(len(idf) * self.blocks + 1))
        self.most = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.most, key, value)
        self.most = self.most.reshape(len(idf), self.blocks)

    def nearest(self, who: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For documents of ids ``who`` (min int64: none): the ``k`` best similarities (0: none), their places in the index, the squared norms."""
        m = len(who)
        sims, at = np.zeros((m, self.k)), np.full((m, self.k), -1, np.int64)
        if not len(doc):
            return sims, at, np.zeros(m)
        weight = (1 + np.log(n)) * self.idf[term]
        mass = np.bincount(doc, weight * weight, m)
        weight = weight / np.sqrt(mass)[doc]
        cut = np.searchsorted(doc, np.arange(m + 1))
        bound = np.zeros((m, self.blocks))
        some = np.flatnonzero(np.diff(cut) > 0)
        bound[some] = np.add.reduceat(weight[:, None] * self.most[term], cut[some], axis=0)
        turn = np.argsort(-bound, axis=1)
        live = some
        for r in range(self.blocks):
            block = turn[live, r]
            ok = (bound[live, block] > 0) & (bound[live, block] >= sims[live, -1] - 1e-8)
            live, block = live[ok], block[ok]  # bounds fall from round to round, so a document that stops is done
            if not len(live):
                break
            length = np.diff(cut)[live]
            job = np.repeat(np.arange(len(live)), length)
            pair = np.arange(int(length.sum())) + np.repeat(cut[live] - (np.cumsum(length) - length), length)
            key = term[pair] * self.blocks + block[job]
            start, size = self.ptr[key], self.ptr[key + 1] - self.ptr[key]
            post = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
            score = np.bincount(np.repeat(job, size) * self.width + self.slot[post], np.repeat(weight[pair], size) * self.value[post], len(live) * self.width).reshape(len(live), self.width)
            place = block[:, None] * self.width + np.arange(self.width)
            score = np.round(score, 9)
            score[(place >= len(self.ids)) | (self.ids[np.minimum(place, len(self.ids) - 1)] == who[live][:, None])] = 0
            both, where = np.concatenate([sims[live], score], axis=1), np.concatenate([at[live], place], axis=1)
            name = np.where(both > 0, self.ids[np.minimum(where, len(self.ids) - 1)], np.iinfo(np.int64).max)
            best = np.lexsort((name, -both), axis=1)[:, : self.k]
            sims[live], at[live] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
        at[sims <= 0] = -1
        return sims, at, mass

    def vote(self, sims: np.ndarray, at: np.ndarray, mass: np.ndarray) -> np.ndarray:
        total = sims.sum(axis=1)
        return np.divide((sims * self.toxic[at]).sum(axis=1), total, out=np.zeros(len(sims)), where=total > 0) * mass / (mass + MASS)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list, float]:
    """Rows ``(doc_id, toxic, text)`` of the sample, and the toxic share of all labels."""
    by = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total, bad = by.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total:
        return [], 0.0
    order = F.md5(F.concat(F.lit(SEED + ":"), F.col("doc_id").cast("string")))
    take = lambda c: by.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class)
    chosen = F.broadcast(take(0).union(take(1)))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.toxic, r.text) for r in rows), bad / total


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary is, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for (texts,) in pieces(batch, 0, 2 << 20):
                df += np.bincount(_terms(texts, shared.value)[1], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int64)), pa.array(np.append(df[seen], rows))], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    is_term = got.term.values >= 0
    df[got.term.values[is_term]] = got.n.values[is_term]
    return df, int(got.n.values[~is_term].sum())


def calibration(vote: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """The toxic probability in each tenth of the vote."""
    bin_ = np.minimum((np.round(vote, 9) * BINS).astype(np.int64), BINS - 1)
    bad, good = (np.bincount(bin_[toxic == c], minlength=BINS) for c in (1, 0))
    a = share * (bad + 0.5) / (bad.sum() + 0.5 * BINS)
    b = (1 - share) * (good + 0.5) / (good.sum() + 0.5 * BINS)
    return a / np.maximum(a + b, 1e-300)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, Index | None, np.ndarray]:
    rows, share = sample(docs, labels, per_class)
    texts, toxic = [r[2] for r in rows], np.array([r[1] for r in rows], np.int64)
    vocabulary = selected(texts, toxic)
    if not len(vocabulary):
        return vocabulary, None, np.zeros(BINS)
    df, total = frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + df)) + 1
    ids = np.array([r[0] for r in rows], np.int64)
    doc, term, n = _terms(texts, vocabulary)
    index = Index(ids, toxic, doc, term, n, idf)
    return vocabulary, index, calibration(index.vote(*index.nearest(ids, doc, term, n)), toxic, share)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, vote, toxicity, toxic, evidence`` for every document."""
    docs, labels = narrowed(docs, "doc_id", "text"), narrowed(labels, "doc_id", "toxic")
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, table = model.value
        for batch in batches:
            for ids, texts in pieces(batch, 1, 2 << 20):
                vote, evidence, known = np.zeros(len(ids)), [""] * len(ids), np.zeros(len(ids), bool)
                if index:
                    who = pa.array(ids, pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
                    sims, at, mass = index.nearest(who, *_terms(texts, vocabulary))
                    vote, known = index.vote(sims, at, mass), at[:, 0] >= 0
                    names = index.ids[at]
                    evidence = [",".join(map(str, names[i, : int((a >= 0).sum())])) for i, a in enumerate(at)]
                p = np.where(known, table[np.minimum((np.round(vote, 9) * BINS).astype(np.int64), BINS - 1)], 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.round(vote, 6)), pa.array(np.round(p, 6)), pa.array(p >= TOXIC), pa.array(evidence, pa.string())], ["doc_id", "vote", "toxicity", "toxic", "evidence"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, vote double, toxicity double, toxic boolean, evidence string")


_BIN = f"least(floor(round(vote, 9) * {BINS})::INT, {BINS - 1})"
SQL = f"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
pick AS (SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) AS r FROM l) WHERE r <= {PER_CLASS}),
wd AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS w FROM documents),
tf AS (SELECT doc_id, w, 1 + ln(count(*)) AS tf FROM (SELECT * FROM wd UNION ALL SELECT doc_id, '<' || substr(w, 1, {STEM}) FROM wd WHERE length(w) > {STEM}) GROUP BY 1, 2),
pk AS (SELECT doc_id, toxic FROM pick JOIN documents USING (doc_id) WHERE text IS NOT NULL),
nn AS (SELECT sum(toxic)::DOUBLE AS na, sum(1 - toxic)::DOUBLE AS nb FROM pk),
ab AS (SELECT w, sum(toxic) AS a, sum(1 - toxic) AS b FROM tf JOIN pk USING (doc_id) GROUP BY w),
vocab AS (SELECT w FROM ab, nn WHERE na > 0 AND nb > 0 AND abs((a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb) + 1e-9) * (1 / na + 1 / nb))) >= {APART}),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf JOIN vocab USING (w) GROUP BY w),
v AS (SELECT doc_id, w, tf * idf AS x FROM tf JOIN idf USING (w)),
u AS (SELECT doc_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM v),
mass AS (SELECT doc_id, sum(x * x) AS m FROM v GROUP BY doc_id),
sim AS (SELECT q.doc_id, e.doc_id AS ex, any_value(p.toxic) AS toxic, round(sum(q.x * e.x), 9) AS s FROM u q JOIN u e ON q.w = e.w AND q.doc_id <> e.doc_id JOIN pick p ON p.doc_id = e.doc_id GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ex) AS r FROM sim WHERE s > 0) WHERE r <= {K}),
votes AS (SELECT doc_id, sum(s * toxic) / sum(s) * any_value(m) / (any_value(m) + {MASS}) AS vote, string_agg(ex::VARCHAR, ',' ORDER BY s DESC, ex) AS evidence FROM top JOIN mass USING (doc_id) GROUP BY doc_id),
loo AS (SELECT least(floor(coalesce(vote, 0) * {BINS})::INT, {BINS - 1}) AS b, toxic FROM pk LEFT JOIN votes USING (doc_id)),
bins AS (SELECT b, coalesce(sum(toxic), 0) AS bad, count(*) - coalesce(sum(toxic), 0) AS good FROM loo GROUP BY b),
allb AS (SELECT g.b, coalesce(bad, 0) AS bad, coalesce(good, 0) AS good FROM (SELECT unnest(range(0, {BINS}))::INT AS b) g LEFT JOIN bins USING (b)),
odds AS (SELECT b, (SELECT avg(toxic) FROM l) * (bad + 0.5) / ((SELECT sum(bad) FROM allb) + 0.5 * {BINS}) AS x, (1 - (SELECT avg(toxic) FROM l)) * (good + 0.5) / ((SELECT sum(good) FROM allb) + 0.5 * {BINS}) AS y FROM allb)
SELECT d.doc_id, round(coalesce(vote, 0), 6) AS vote, CASE WHEN vote IS NULL THEN 0 ELSE round(x / (x + y), 6) END AS toxicity, vote IS NOT NULL AND x / (x + y) >= {TOXIC} AS toxic, coalesce(evidence, '') AS evidence
FROM documents d LEFT JOIN votes USING (doc_id) LEFT JOIN odds ON odds.b = {_BIN}"""
