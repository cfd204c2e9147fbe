"""Structured Streaming: an index that follows files as they arrive, and rates by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.embedders import hashed
from cairn.operators.maintain import replaced
from cairn.sources.paths import Files
from cairn.sources.shared import scratch


def newest(files: DataFrame) -> DataFrame:
    """One row a path: the latest; of equal times the greatest text."""
    w = Window.partitionBy("file_path").orderBy(F.desc("file_modified_at"), F.desc("text"))
    return files.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def keep_index(spark: SparkSession, target: str, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: newer files replace what they had. A batch that runs again finds its version there and leaves it."""
    files = Files(spark)

    def apply(batch: DataFrame, epoch: int) -> None:
        pointer, version = f"{target}/current", f"{target}/v{epoch}"
        old_name = files.read(pointer) if files.exists(pointer) else None
        if old_name is not None and int(old_name[1:]) >= epoch:
            return
        new = newest(batch)
        if old_name is not None:
            old = spark.read.parquet(f"{target}/{old_name}")
            stored = old.select("file_path", F.col("file_modified_at").alias("__m"))
            new = new.join(stored, "file_path", "left").where("__m is null or file_modified_at > __m").drop("__m")
            rows = embed(new)
            rows = replaced(old, rows, rows)
        else:
            rows = embed(new)
        rows.write.mode("overwrite").parquet(version)
        files.write(pointer, f"v{epoch}")

    return apply


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Takes in all files that are there and ends; run again, it takes in what is new."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(keep_index(spark, target, embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{Files(spark).read(f'{target}/current')}")


def _hashed(files: DataFrame) -> DataFrame:
    # the vectors' join is on the key of the batch itself
    return files.select("file_path", "file_modified_at", "text").join(hashed(files, "file_path", "text"), "file_path")


def demo(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 200")
    root = scratch(spark, "stream")
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file_path"), "text")
    schema = "file_path string, file_modified_at timestamp, text string"
    for step, own in enumerate((files.where("doc_id % 2 = 0").withColumn("file_modified_at", at(1)), files.where("doc_id % 3 = 0").withColumn("file_modified_at", at(2)).withColumn("text", F.upper("text")), files.where("doc_id % 6 = 0").withColumn("file_modified_at", at(1)))):
        own.select("file_path", "file_modified_at", "text").write.mode("append").parquet(f"{root}/in")
        follow(spark, f"{root}/in", schema, f"{root}/index", f"{root}/checkpoint", _hashed, files_per_batch=4 + step).awaitTermination()
    return current(spark, f"{root}/index").select("file_path", F.col("file_modified_at").cast("long").alias("modified"), F.size("embedding").alias("dimension"))


def rates(spark: SparkSession, path: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``at, event_type, n, total`` by event time. The watermark bounds the state; at the end all windows are out."""
    root = scratch(spark, "rates")
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; a single file is found in its own by name
    folder, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    events = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    table = f"rates_{root[-32:]}"
    q = by.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table).select(F.col("w.start").cast("timestamp_ntz").alias("at"), "event_type", "n", F.round("total", 4).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
