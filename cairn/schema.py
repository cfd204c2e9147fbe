"""Table schemas, value types and errors of the index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CHUNK_TYPES = ("whole", "chunk", "pdf_page", "image")

CHUNKS = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("file_path", T.StringType(), False), T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("chunk_type", T.StringType(), False),
    T.StructField("page_number", T.IntegerType()), T.StructField("file_modified_at", T.TimestampType(), False),
    T.StructField("content_preview", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

INDEXED_FILES = T.StructType([
    T.StructField("file_path", T.StringType(), False), T.StructField("file_modified_at", T.TimestampType(), False), T.StructField("line_page_count", T.LongType()),
])

FILES = T.StructType([
    T.StructField("file_path", T.StringType(), False), T.StructField("file_modified_at", T.TimestampType(), False), T.StructField("content", T.BinaryType()),
])

LOG = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("timestamp", T.StringType()), T.StructField("embedder", T.StringType()), T.StructField("profile", T.StringType()),
    T.StructField("wallSeconds", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("filesScanned", "added", "updated", "removed", "unchanged")),
    T.StructField("skippedUnreadable", T.ArrayType(T.StringType())), T.StructField("skippedEmbedFailures", T.ArrayType(T.StringType())),
    T.StructField("partialEmbedFailures", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("failedChunks", T.LongType()), T.StructField("totalChunks", T.LongType())]))),
])


class IndexError_(Exception):
    """Base of the index's own errors."""


class NotInitialized(IndexError_):
    """The store has no tables."""


class Corrupted(IndexError_):
    """A table is missing or has another schema."""


class DimensionMismatch(IndexError_):
    def __init__(self, expected: int, got: int):
        super().__init__(f"vectors have {got} elements, the store holds {expected}")


class BadIdentity(IndexError_):
    """Not a profile identity."""


class UnknownProfile(IndexError_):
    """No embedder of that alias."""


class BadChunkParameters(IndexError_):
    """size must be above 0 and overlap in [0, size)."""


class ProfileMismatch(IndexError_):
    """The store was built under another profile."""


class ProfileNotRecorded(IndexError_):
    """The store is empty and has no profile yet."""


class PreProfileStore(IndexError_):
    """The store has chunks but no profile."""


class PartialOverride(IndexError_):
    """Chunk size and overlap must be given together."""


class BadName(IndexError_):
    """Not a store name."""


class NoSuchStore(IndexError_):
    """No store of that name or for that folder."""


class AmbiguousFolder(IndexError_):
    """Several stores index that folder."""


class AlreadyExists(IndexError_):
    """The store exists; use force."""


class Busy(IndexError_):
    """Another run holds the store."""


class OutsideSource(IndexError_):
    """The path is not under the indexed folder."""


class EmbedFailed(IndexError_):
    """The embedder gave no vector."""


class AllFailed(IndexError_):
    """Work was to be done and every file failed to embed."""


@dataclass(frozen=True)
class ProfileRecord:
    identity: str
    embedder: str
    dimension: int


@dataclass
class StoreConfig:
    source_directory: str
    created_at: str
    profile: ProfileRecord | None = None
    buckets: int = 64


@dataclass
class UpdateReport:
    files_scanned: int = 0
    added: int = 0
    updated: int = 0
    removed: int = 0
    unchanged: int = 0
    skipped_unreadable: list[str] = field(default_factory=list)
    skipped_embed_failures: list[str] = field(default_factory=list)
    partial_embed_failures: list[dict] = field(default_factory=list)
    wall_seconds: float = 0.0
