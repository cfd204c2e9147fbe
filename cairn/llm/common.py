"""What the training-data operators share: tables, the shared folder, joins of a checked size."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many bytes, as measured, may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between the JVM and Python: ten thousand documents, as by default, would be tens of MB on either side of each task.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Makes such batches smaller in this session unless it says otherwise."""
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs on this machine is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cairn-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and its size is known."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``: that of its files for a table just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_of(docs: DataFrame, each: int = 2 << 20) -> int:
    """Into how many groups to cut what is made of ``docs``, so that a group, which one worker holds, does not grow with the table: one for each
    ``each`` bytes of its files, and several for each shuffle partition, so that partitions are even."""
    return max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size_in_bytes(docs) // each, 1 << 22))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its files are small (unpacked they may be four times as large)."""
    return F.broadcast(df) if 4 * size_in_bytes(df) <= limit else df


#: The columns of ``documents``; whatever else a table holds is carried under a private name.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, found by place, so that others that differ by case or repeat do not clash."""
    lean(df.sparkSession)
    columns = df.columns
    places = [columns.index(n) for n in names]
    return df.toDF(*(f"__c{i}" for i in range(len(columns)))).select(*(F.col(f"__c{i}").alias(n) for i, n in zip(places, names, strict=True)))


def guarded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that sees its own columns under their names and all others under private ones, and gives all of them back as they were."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        columns, seen = docs.columns, set()
        private = []
        for i, c in enumerate(columns):
            private.append(c if c in DOCUMENT and c not in seen else f"__extra{i}")
            seen.add(c)
        return stage(docs.toDF(*private), *args, **kwargs).select(*private).toDF(*columns)

    return run
