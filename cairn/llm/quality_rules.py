"""Operator 8. Quality rules at the level of hosts.

Each document is held against five rules. Failures are counted by host; the rates of the hosts are
shrunk toward a beta prior whose two parameters are fitted to all hosts by moments; a host is bad at a rule when its
shrunk rate lies more than ``Z`` standard deviations of that prior above the prior's mean, and above ``LEAST``. The verdict is joined back to its
documents. A document is rejected when it breaks a rule's hard limit, or the soft limit of a rule that its host is bad at.
A document that breaks no soft limit is kept whatever its host is.

Texts are measured in Arrow batches, all texts of a batch at once, and leave a few bits each; nothing else of a text moves.

Defined results: a null text counts as empty, and an empty text or one without a word breaks no rule
but ``short`` (hard when there is no word at all); a null host is the host ``(none)``; repeated rows are
judged each for itself; null ids pass through; extra columns are left alone; an empty table gives an
empty result. Very long texts are measured whole. Rates and limits are strict: what is equal to a limit does not break it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cairn.llm.common import guarded, narrowed, small, written
from cairn.llm.text import pieces, ranges_hash, released

SYMBOLS = "#$%&*|!{}<>~^\\"
#: rule -> (soft limit, hard limit)
RULES: dict[str, tuple[float, float]] = {
    "short": (3.0, 1.0),  # words fewer than
    "symbols": (0.10, 0.20),  # symbols per word above
    "shouting": (0.30, 0.45),  # share of capitals above
    "repeats": (0.30, 0.42),  # share of words that only repeat the word before, above
    "exclaims": (0.25, 0.50),  # exclamation and question marks per word above
}
#: A bad host's shrunk rate is so many standard deviations of the fitted prior above its mean, and at least so high.
Z, LEAST = 1.0, 0.02
_SPACE, _SYMBOL, _CAPITAL, _MARK = 1, 2, 4, 8
_TOP = 0x20000


@functools.cache
def _kinds() -> np.ndarray:
    """What each character counts as; beyond ``_TOP`` there is nothing to count."""
    kinds = np.zeros(_TOP + 1, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    kinds[[c for c in range(_TOP) if unicodedata.category(chr(c)) == "Lu"]] |= _CAPITAL
    kinds[list(map(ord, SYMBOLS))] |= _SYMBOL
    kinds[[ord("!"), ord("?")]] |= _MARK
    return kinds


def marks_of(texts: list[str | None]) -> np.ndarray:
    """The rules that each text breaks, as bits: the soft limits of the rules in their order, then the hard ones."""
    texts = [t or "" for t in texts]
    if not texts:
        return np.empty(0, np.int32)
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    kind = _kinds()[np.minimum(chars, _TOP)]
    count = lambda bit: np.add.reduceat((kind & bit) != 0, begin, dtype=np.int64)
    solid = np.zeros(len(chars) + 1, bool)
    solid[1:] = (kind & _SPACE) == 0
    edge = np.flatnonzero(solid[1:] != solid[:-1])  # each text ends with a space, so words do
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, np.append(begin, len(chars)))
    words = np.diff(first)
    h = ranges_hash(chars, start, end)
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    of = np.searchsorted(first, again, "right") - 1
    again = np.bincount(of[again > first[of]], minlength=len(texts))
    per = np.maximum(words, 1)
    squeezed = size - count(_SPACE) + np.maximum(words - 1, 0)
    m = {"symbols": count(_SYMBOL) / per, "shouting": count(_CAPITAL) / np.maximum(squeezed, 1), "repeats": again / per, "exclaims": count(_MARK) / per}
    out = np.zeros(len(texts), np.int32)
    for i, (rule, limits) in enumerate(RULES.items()):
        for j, limit in enumerate(limits):
            out |= (words < limit if rule == "short" else m[rule] > limit).astype(np.int32) << (i + j * len(RULES))
    return out


def _bit(rule: str, hard: bool = False) -> Column:
    """0 or 1: whether a document breaks a rule's limit."""
    return F.shiftright(F.col("__marks"), list(RULES).index(rule) + hard * len(RULES)).bitwiseAND(F.lit(1))


def marked(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` without its texts: ``doc_id, __host, __marks``."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [marks_of(texts) for (texts,) in pieces(batch.select(["text"]), 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__host"), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))], ["doc_id", "__host", "__marks"])

    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("__host"), "text")
    return given.mapInArrow(run, f"doc_id {kind}, __host string, __marks int")


def host_verdicts(marks: DataFrame) -> DataFrame:
    """One row a host: ``__host, n_docs, rate_<rule>, bad_<rule>`` with shrunk rates."""
    hosts = marks.groupBy("__host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(_bit(r)).alias(f"f_{r}") for r in RULES))
    total = [F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h")]
    means = hosts.agg(*total, *((F.sum(f"f_{r}") / F.sum("n_docs")).alias(f"m_{r}") for r in RULES))
    spread = hosts.crossJoin(F.broadcast(means)).groupBy().agg(  # one row
        F.first("n").alias("n"), F.first("h").alias("h"), *(F.first(f"m_{r}").alias(f"m_{r}") for r in RULES),
        *((F.sum(F.col("n_docs") * F.pow(F.col(f"f_{r}") / F.col("n_docs") - F.col(f"m_{r}"), 2)) / F.first("n")).alias(f"v_{r}") for r in RULES),
    )
    strengths = {}
    for r in RULES:
        inside = F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
        between = F.greatest(F.col(f"v_{r}") - inside * F.col("h") / F.col("n"), F.lit(1e-9))
        strengths[f"k_{r}"] = F.least(F.greatest(inside / between - 1, F.lit(1.0)), F.lit(1000.0))
    prior = spread.withColumns(strengths).select(*(f"m_{r}" for r in RULES), *(f"k_{r}" for r in RULES))
    rates = {f"rate_{r}": (F.col(f"f_{r}") + F.col(f"m_{r}") * F.col(f"k_{r}")) / (F.col("n_docs") + F.col(f"k_{r}")) for r in RULES}
    high = {f"bad_{r}": F.col(f"rate_{r}") > F.greatest(F.col(f"m_{r}") + Z * F.sqrt(F.col(f"m_{r}") * (1 - F.col(f"m_{r}")) / (F.col(f"k_{r}") + 1)) + 1e-12, F.lit(LEAST)) for r in RULES}
    return hosts.crossJoin(F.broadcast(prior)).withColumns(rates).withColumns(high).select("__host", "n_docs", *rates, *high)  # one row


def _keep() -> Column:
    broken = F.lit(False)
    for r in RULES:
        broken = broken | (_bit(r, True) == 1) | ((_bit(r) == 1) & F.col(f"bad_{r}"))
    return ~broken


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """The query's result: a row for each document."""
    marks = written(marked(narrowed(docs, "doc_id", "text", "source")), "marks")
    df = marks.join(small(written(host_verdicts(marks), "hosts")), "__host")
    names = F.concat_ws(",", *(F.when(_bit(r) == 1, F.lit(r)) for r in RULES))
    bad = F.concat_ws(",", *(F.when(F.col(f"bad_{r}"), F.lit(r)) for r in RULES))
    return df.select(
        "doc_id", F.col("__host").alias("host"), names.alias("failed_rules"),
        *(F.round(f"rate_{r}", 6).alias(f"host_rate_{r}") for r in RULES), bad.alias("host_bad_at"), (bad != "").alias("bad_host"), _keep().alias("keep"),
    )


@F.arrow_udf(returnType=IntegerType())
def _marks(text: pa.Array) -> pa.Array:
    parts = [marks_of(texts) for (texts,) in pieces(pa.RecordBatch.from_arrays([text], ["text"]), 0)]
    return pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))


@guarded
def drop_rejected(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the rows of ``docs`` that are kept, with their own columns.

    Texts are measured once for the hosts and once where rows are dropped: to write them in between would cost a copy of the table.
    """
    hosts = written(host_verdicts(marked(docs.select("doc_id", "text", "source"))), "hosts")
    host = F.coalesce(F.col("source").cast("string"), F.lit("(none)"))
    df = docs.withColumn("__marks", _marks("text")).withColumn("__host", host).join(small(hosts), "__host")
    return df.where(_keep()).select(*(f"`{c}`" for c in docs.columns))


def _sql() -> str:
    sym = "".join("\\" + c for c in SYMBOLS)
    marks = ", ".join(
        (f"(words < {limit})::INT AS {kind}_{rule}" if rule == "short" else f"(m_{rule} > {limit})::INT AS {kind}_{rule}")
        for rule, (soft, hard) in RULES.items() for kind, limit in (("soft", soft), ("hard", hard))
    )
    mean = ", ".join(f"sum(f_{r}) / sum(n_docs) AS m_{r}" for r in RULES)
    var = ", ".join(f"sum(n_docs * (f_{r} / n_docs - m_{r}) ** 2) / any_value(n) AS v_{r}, any_value(m_{r}) AS m_{r}" for r in RULES)
    k = ", ".join(f"m_{r}, least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * h / n, 1e-9) - 1, 1.0), 1000.0) AS k_{r}" for r in RULES)
    rate = ", ".join(f"(f_{r} + m_{r} * k_{r}) / (n_docs + k_{r}) AS rate_{r}" for r in RULES)
    high = ", ".join(f"rate_{r} > greatest(m_{r} + {Z} * sqrt(m_{r} * (1 - m_{r}) / (k_{r} + 1)) + 1e-12, {LEAST}) AS bad_{r}" for r in RULES)
    bad = "concat_ws(',', " + ", ".join(f"CASE WHEN bad_{r} THEN '{r}' END" for r in RULES) + ")"
    broken = " OR ".join(f"hard_{r} = 1 OR (soft_{r} = 1 AND bad_{r})" for r in RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '(none)') AS host, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' ') AS s FROM documents),
w AS (SELECT *, string_split(s, ' ') AS p FROM t),
m0 AS (SELECT doc_id, host, CASE WHEN length(s) = 0 THEN 0 ELSE len(p) END AS words, length(t) - length(regexp_replace(t, '[{sym}]', '', 'g')) AS sy,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS ex,
  (length(s) - length(regexp_replace(s, '\\p{{Lu}}', '', 'g'))) / greatest(length(s), 1) AS m_shouting,
  len(list_filter(range(1, len(p)), lambda i: p[i] = p[i + 1])) AS rp FROM w),
m AS (SELECT *, sy / greatest(words, 1) AS m_symbols, rp / greatest(words, 1) AS m_repeats, ex / greatest(words, 1) AS m_exclaims FROM m0),
f AS (SELECT doc_id, host, {marks} FROM m),
hosts AS (SELECT host, count(*) AS n_docs, {", ".join(f"sum(soft_{r}) AS f_{r}" for r in RULES)} FROM f GROUP BY host),
means AS (SELECT sum(n_docs) AS n, count(*) AS h, {mean} FROM hosts),
spread AS (SELECT any_value(n) AS n, any_value(h) AS h, {var} FROM hosts, means),
prior AS (SELECT {k} FROM spread),
rates AS (SELECT host, {rate}, {", ".join(f"m_{r}, k_{r}" for r in RULES)} FROM hosts, prior),
verdict AS (SELECT *, {high} FROM rates)
SELECT doc_id, host, concat_ws(',', {", ".join(f"CASE WHEN soft_{r} = 1 THEN '{r}' END" for r in RULES)}) AS failed_rules,
  {", ".join(f"round(rate_{r}, 6) AS host_rate_{r}" for r in RULES)}, {bad} AS host_bad_at, {bad} <> '' AS bad_host, NOT ({broken}) AS keep
FROM f JOIN verdict USING (host)"""


SQL = _sql()
