"""Embedders: a registry of versioned profiles, and one that needs no model weights.

The registry keeps the identities, sizes, caps and prefixes of nine known models. Their weights are not shipped; a model is plugged in by
``register`` with a function from texts to vectors. The hashing embedder counts words in hashed buckets: it is lexical and says
nothing about meaning, but makes every flow run and can be checked exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.chunkers import check_parameters
from cairn.functions.text import embed_input
from cairn.functions.vectors import l2_normalize
from cairn.schema import BadIdentity, PartialOverride, UnknownProfile

Embed = Callable[[list[str]], "list[np.ndarray | None]"]


@dataclass(frozen=True)
class Profile:
    alias: str
    embedder: str
    dimension: int
    chunk_size: int
    chunk_overlap: int
    max_chars: int
    document_prefix: str = ""
    query_prefix: str = ""
    normalized: bool = True
    built_in: bool = True

    @property
    def identity(self) -> str:
        return f"{self.alias}@{self.chunk_size}/{self.chunk_overlap}"


DEFAULT_ALIAS = "e5-base"
REGISTRY: dict[str, Profile] = {
    p.alias: p
    for p in (
        Profile("e5-base", "e5-base-v2", 768, 1200, 0, 2000, "passage: ", "query: "),
        Profile("bge-base", "bge-base-en-v1.5", 768, 1200, 240, 2000),
        Profile("bge-small", "bge-small-en-v1.5", 384, 1200, 0, 2000),
        Profile("bge-large", "bge-large-en-v1.5", 1024, 1200, 0, 2000),
        Profile("nomic", "nomic-v1.5-768", 768, 1200, 240, 30000, "search_document: ", "search_query: "),
        Profile("nl", "nl-en-512", 512, 2000, 200, 10000, normalized=False),
        Profile("nl-contextual", "nl-contextual-en-512", 512, 1200, 240, 2000),
        Profile("gte-base", "gte-base-en-v1.5", 768, 1600, 0, 2000),
        Profile("mxbai-large", "mxbai-embed-large-v1", 1024, 800, 80, 2000, "", "Represent this sentence for searching relevant passages: "),
        Profile("hashing", "hashing-md5", 64, 1200, 0, 1 << 30),
    )
}
_MODELS: dict[str, Embed] = {}


def register(alias: str, embed: Embed, profile: Profile | None = None) -> None:
    """Plugs a model in under an alias of the registry, or under a new profile."""
    if profile is not None:
        REGISTRY[alias] = profile
    if alias not in REGISTRY:
        raise UnknownProfile(alias)
    _MODELS[alias] = embed


def make_profile(alias: str = DEFAULT_ALIAS, size: int | None = None, overlap: int | None = None) -> Profile:
    """A registry profile, at its own chunk sizes or at both given ones."""
    if alias not in REGISTRY:
        raise UnknownProfile(alias)
    base = REGISTRY[alias]
    if (size is None) != (overlap is None):
        raise PartialOverride(alias)
    if size is None or overlap is None:
        return base
    check_parameters(size, overlap)
    return replace(base, chunk_size=size, chunk_overlap=overlap, built_in=(size, overlap) == (base.chunk_size, base.chunk_overlap))


def resolve(identity: str) -> Profile:
    """The profile that an identity names."""
    m = re.fullmatch(r"([a-z0-9-]+)@([1-9][0-9]*)/([0-9]+)", identity, re.ASCII)
    if not m or f"{m[1]}@{int(m[2])}/{int(m[3])}" != identity or max(int(m[2]), int(m[3])) > 2**31 - 1:
        raise BadIdentity(identity)
    return make_profile(m[1], int(m[2]), int(m[3]))


_WORDS = re.compile(r"[^a-z0-9]+")


def hashing_vectors(texts: list[str], dim: int = 64) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    cache: dict[str, int] = {}
    for t in texts:
        v = np.zeros(dim)
        for w in filter(None, _WORDS.split(t.lower())):
            b = cache.get(w)
            if b is None:
                b = cache[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
            v[b] += 1
        n = np.sqrt((v * v).sum())
        out.append(v / n if n else None)
    return out


def hashing_buckets(text: Column, dim: int = 64) -> Column:
    """The hashing embedder as an expression: an array of ``dim`` doubles of length 1, empty if there is no word."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return F.when(F.size(buckets) > 0, l2_normalize(counts)).otherwise(F.array().cast("array<double>"))


def _model(alias: str) -> Embed:
    if alias in _MODELS:
        return _MODELS[alias]
    if alias == "hashing":
        return lambda texts: hashing_vectors(texts, REGISTRY["hashing"].dimension)
    raise UnknownProfile(f"{alias} has no model here; give one to register()")


def _batches(embed: Embed, texts: list[str | None], dim: int, size: int) -> list:
    """Vectors in place; null for null texts, for items that failed and for all of a batch that failed as a whole."""
    out: list = [None] * len(texts)
    # texts of like length together, for the sake of models that pad
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i] or ""))
    for k in range(0, len(order), size):
        part = order[k : k + size]
        try:
            got = embed([texts[i] or "" for i in part])
        except Exception:  # noqa: BLE001 - a model's failure is an outcome of its files, not of the job
            continue
        for i, v in zip(part, got, strict=True):
            if v is not None and len(v) == dim:
                out[i] = v
    return out


def embedded(chunks: DataFrame, profile: Profile, text: str = "text", batch: int = 32) -> DataFrame:
    """``chunks`` with ``embedding``: null where there was nothing to embed or the model failed."""
    embed, dim = _model(profile.alias), profile.dimension

    @F.pandas_udf("array<float>")
    def vectors(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(_batches(embed, s.tolist(), dim, min(max(batch, 1), 32)), dtype=object)

    return chunks.withColumn("embedding", vectors(embed_input(F.col(text), profile.max_chars, profile.document_prefix)))


def embed_query(query: str, profile: Profile) -> np.ndarray:
    text = query.strip()[: profile.max_chars]
    got = _model(profile.alias)([profile.query_prefix + text])[0] if text else None
    if got is None or not len(got):
        from cairn.schema import EmbedFailed

        raise EmbedFailed(query)
    return np.asarray(got, np.float64)


def hashed(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key, embedding`` of documents under the hashing embedder, in Arrow batches; wordless texts give an empty vector."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [[] if x is None else x.tolist() for x in hashing_vectors([t or "" for t in b.column(1).to_pylist()], dim)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float64()))], [key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")
