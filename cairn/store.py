"""A named vector store: versioned Parquet, kept up to date by file, searched exactly.

The rows of a file live in the bucket of its name's hash. A change writes new folders for the buckets it touches and then a manifest that names
the folders of all buckets; the pointer to the manifest is swapped last. Readers see the old or the new version, untouched buckets are
never rewritten, and nothing is overwritten while it is read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.chunkers import recursive_chunks, text_counts
from cairn.functions.embedders import DEFAULT_ALIAS, Profile, embed_query, embedded, make_profile, resolve
from cairn.functions.text import extension, valid_name
from cairn.operators import maintain as mt
from cairn.operators import search as se
from cairn.schema import CHUNKS, INDEXED_FILES, AlreadyExists, AllFailed, AmbiguousFolder, BadName, Busy, Corrupted, DimensionMismatch, NoSuchStore, NotInitialized, PreProfileStore, ProfileMismatch, ProfileNotRecorded, ProfileRecord, StoreConfig, UpdateReport
from cairn.sources.files import IMAGE_EXTENSIONS, page_chunks, texts
from cairn.sources.paths import Files
from cairn.sources.shared import scratch

#: A store's buckets unless it is made with another number: choose it so that a bucket stays at a few hundred MB.
BUCKETS = 64
LOG_KEPT = 200
_TABLES = {"chunks": CHUNKS, "indexed_files": INDEXED_FILES}


class VectorStore:
    def __init__(self, spark: SparkSession, home: str, name: str):
        self.spark, self.home, self.name, self.path, self.files = spark, home, name, f"{home}/{name}", Files(spark)

    # lifecycle

    @staticmethod
    def create(spark: SparkSession, home: str, name: str, source_directory: str, force: bool = False, buckets: int = BUCKETS) -> VectorStore:
        if not valid_name(name):
            raise BadName(name)
        store = VectorStore(spark, home, name)
        if store.files.exists(store.path):
            if not force:
                raise AlreadyExists(name)
            store.drop()
        store._save_config(StoreConfig(source_directory, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), buckets=buckets))
        store._point({t: {} for t in _TABLES})
        return store

    @staticmethod
    def open(spark: SparkSession, home: str, name: str) -> VectorStore:
        store = VectorStore(spark, home, name)
        if not store.files.exists(f"{store.path}/config.json"):
            raise NoSuchStore(name)
        store._manifest()
        return store

    @staticmethod
    def catalog(spark: SparkSession, home: str) -> DataFrame:
        """``name, source_directory, identity`` of all stores, by name."""
        files = Files(spark)
        rows = []
        for n in files.folders(home):
            if files.exists(f"{home}/{n}/config.json"):
                c = VectorStore(spark, home, n).config()
                rows.append((n, c.source_directory, c.profile.identity if c.profile else None))
        return spark.createDataFrame(rows, "name string, source_directory string, identity string").orderBy("name")

    @staticmethod
    def for_directory(spark: SparkSession, home: str, directory: str) -> VectorStore:
        """The one store that indexes a folder."""
        names = [r.name for r in VectorStore.catalog(spark, home).where(F.col("source_directory") == directory).collect()]
        if not names:
            raise NoSuchStore(directory)
        if len(names) > 1:
            raise AmbiguousFolder(", ".join(names))
        return VectorStore.open(spark, home, names[0])

    def drop(self) -> None:
        self.files.delete(self.path)

    def reset(self) -> VectorStore:
        """Empty, with the same folder, without profile and log."""
        c = self.config()
        return VectorStore.create(self.spark, self.home, self.name, c.source_directory, force=True, buckets=c.buckets)

    def config(self) -> StoreConfig:
        d = json.loads(self.files.read(f"{self.path}/config.json"))
        p = d.get("profile")
        return StoreConfig(d["sourceDirectory"], d["createdAt"], ProfileRecord(p["identity"], p["embedderName"], p["dimension"]) if p else None, d.get("buckets", BUCKETS))

    def _save_config(self, c: StoreConfig) -> None:
        d: dict = {"sourceDirectory": c.source_directory, "createdAt": c.created_at, "buckets": c.buckets}
        if c.profile:
            d["profile"] = {"identity": c.profile.identity, "embedderName": c.profile.embedder, "dimension": c.profile.dimension}
        self.files.write(f"{self.path}/config.json", json.dumps(d, indent=2, sort_keys=True))

    # versions

    def _manifest(self) -> dict[str, dict[str, str]]:
        pointer = f"{self.path}/current"
        if not self.files.exists(pointer):
            raise NotInitialized(self.name)
        m = json.loads(self.files.read(f"{self.path}/{self.files.read(pointer)}"))
        if set(m) != set(_TABLES):
            raise Corrupted(f"{self.name} has tables {sorted(m)}")
        return m

    def _point(self, manifest: dict[str, dict[str, str]]) -> None:
        name = f"manifest-{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"
        self.files.write(f"{self.path}/{name}", json.dumps(manifest))
        self.files.write(f"{self.path}/current", name)

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        folders = self._manifest()[name]
        paths = sorted({p for b, p in folders.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*(f"{self.path}/{p}" for p in paths))

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def indexed_files(self) -> DataFrame:
        return self.table("indexed_files")

    def _commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame]]) -> None:
        """Per table: new rows, or none, in place of all rows of some paths. All tables change by one swap of the pointer."""
        manifest = self._manifest()
        bucket = F.pmod(F.xxhash64("file_path"), F.lit(self.config().buckets))
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        for name, (new, paths) in changes.items():
            touched = [r.b for r in paths.select(bucket.alias("b")).distinct().collect()]  # at most a row a bucket
            if not touched:
                continue
            rows = self.table(name, touched).join(paths.select("file_path"), "file_path", "left_anti")
            if new is not None:
                rows = rows.select(*_TABLES[name].names).unionByName(new.select(*_TABLES[name].names))
            # a folder a bucket; files in the order of their path, so that a lookup reads little
            out = rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "file_path", *(["ordinal"] if name == "chunks" else []))
            out.write.partitionBy("bucket").parquet(f"{self.path}/{version}/{name}")
            made = {f.removeprefix("bucket=") for f in self.files.folders(f"{self.path}/{version}/{name}")}
            for b in map(str, touched):
                manifest[name].pop(b, None)
                if b in made:
                    manifest[name][b] = f"{version}/{name}/bucket={b}"
        self._point(manifest)

    # profile

    def require_profile(self) -> Profile:
        """The recorded profile, for search and single inserts."""
        record = self.config().profile
        if record is None:
            raise PreProfileStore(self.name) if self.chunks.limit(1).count() else ProfileNotRecorded(self.name)
        return resolve(record.identity)

    def _profile_for_update(self, alias: str | None, size: int | None, overlap: int | None) -> Profile:
        config = self.config()
        record = config.profile
        wanted = make_profile(alias or (resolve(record.identity).alias if record else DEFAULT_ALIAS), size, overlap)
        if record is None:
            if self.chunks.limit(1).count():
                raise PreProfileStore(self.name)
            config.profile = ProfileRecord(wanted.identity, wanted.embedder, wanted.dimension)
            self._save_config(config)  # before any vector is written
        elif record.identity != wanted.identity:
            raise ProfileMismatch(f"{record.identity} recorded, {wanted.identity} asked for")
        return wanted

    # maintenance

    def insert_rows(self, chunks: DataFrame) -> None:
        """Rows of ``chunks`` as they are, in place of what their files had."""
        record = self.config().profile
        if record is not None:
            wrong = chunks.where(F.size("embedding") != record.dimension).select(F.size("embedding")).first()
            if wrong:
                raise DimensionMismatch(record.dimension, wrong[0])
        self._commit({"chunks": (chunks, chunks.select("file_path").distinct())})

    def mark_indexed(self, rows: DataFrame) -> None:
        self._commit({"indexed_files": (rows, rows)})

    def unmark(self, path: str) -> None:
        self._commit({"indexed_files": (None, self._one(path))})

    def remove(self, path: str) -> int:
        """How many chunks the path had; they and its mark are gone."""
        n = self.chunks.where(F.col("file_path") == path).count()
        self._commit({"chunks": (None, self._one(path)), "indexed_files": (None, self._one(path))})
        return n

    def _one(self, path: str) -> DataFrame:
        return self.spark.createDataFrame([(path,)], "file_path string")

    def _chunked(self, files: DataFrame, profile: Profile) -> DataFrame:
        is_page = extension(F.col("file_path")).isin("pdf", *IMAGE_EXTENSIONS)
        text = recursive_chunks(texts(files.where(~is_page)), "file_path", "text", profile.chunk_size, profile.chunk_overlap).withColumn("page_number", F.lit(None).cast("int"))
        for kind in ("pdf", "image"):
            text = text.unionByName(page_chunks(files, kind), allowMissingColumns=True)
        return text

    def update(self, files: DataFrame, alias: str | None = None, size: int | None = None, overlap: int | None = None, batch: int = 32, allow_removal: bool = True) -> UpdateReport:
        """Brings the index to ``files(file_path, file_modified_at, content)``, the folder as it is now.

        New and newer files are chunked, embedded and replace what they had; a file of which nothing could be embedded keeps its old rows and mark and is
        tried again next time; vanished ones go.
        """
        lock = f"{self.path}/lock"
        if not self.files.create_once(lock, str(time.time_ns())):
            raise Busy(self.name)
        try:
            return self._update(files, alias, size, overlap, batch, allow_removal)
        finally:
            self.files.delete(lock)

    def _update(self, files: DataFrame, alias: str | None, size: int | None, overlap: int | None, batch: int, allow_removal: bool) -> UpdateReport:
        began = time.time()
        profile = self._profile_for_update(alias, size, overlap)
        indexed = self.indexed_files
        labelled = mt.detect_changes(files.select("file_path", "file_modified_at"), indexed)
        labels = self._kept(labelled, "labels")
        work = labels.where("label <> 'Unchanged'").select("file_path", "label")
        todo = files.join(work, "file_path")
        vectors = self._kept(embedded(self._chunked(todo, profile), profile, batch=batch).join(todo.select("file_path", "file_modified_at"), "file_path"), "vectors")
        totals = vectors.groupBy("file_path").agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("ok"))
        out = work.join(totals, "file_path", "left").na.fill(0, ["total", "ok"])
        out = self._kept(out.withColumn("outcome", mt.outcome(F.col("total"), F.col("ok"))).withColumn("failed", F.col("total") - F.col("ok")), "outcomes")
        row = mt.all_failed(mt.tally(out)).first()
        good = out.where("outcome = 'indexed'").select("file_path")
        new = vectors.where("embedding is not null").select(
            F.xxhash64("file_path", "ordinal").alias("id"), "file_path", "ordinal", "line_start", "line_end", "chunk_type", "page_number", "file_modified_at", F.substring("text", 1, 200).alias("content_preview"), "embedding",
        )
        counts = text_counts(texts(todo)).select("file_path", "line_page_count")
        pages = vectors.groupBy("file_path").agg(F.max("page_number").cast("long").alias("pages"))
        is_page = extension(F.col("file_path")).isin("pdf", *IMAGE_EXTENSIONS)
        marks = todo.select("file_path", "file_modified_at").join(good, "file_path", "left_semi").join(counts, "file_path", "left").join(pages, "file_path", "left")
        marks = marks.select("file_path", "file_modified_at", F.when(is_page, F.col("pages")).otherwise(F.col("line_page_count")).alias("line_page_count"))
        gone = mt.removed_files(files, indexed).select("file_path") if allow_removal else self.spark.createDataFrame([], "file_path string")
        gone = self._kept(gone, "gone")
        touched = good.union(gone)
        self._commit({"chunks": (new, touched), "indexed_files": (marks, touched)})
        by = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
        names = lambda cond: sorted(r.file_path for r in out.where(cond).select("file_path").collect())
        partial = [{"path": r.file_path, "failedChunks": r.failed, "totalChunks": r.total} for r in out.where("outcome = 'indexed' and failed > 0").orderBy("file_path").collect()]
        report = UpdateReport(sum(by.values()), row.added, row.updated, gone.count(), by.get("Unchanged", 0), names("outcome = 'skippedUnreadable'"), names("outcome = 'skippedEmbedFailure'"), partial, time.time() - began)
        self._log(profile, report)
        if row.all_failed:
            raise AllFailed(f"{len(report.skipped_embed_failures)} files failed to embed")
        return report

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table between the jobs of one update: an executor's loss costs no second embedding."""
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(T.StructType.fromJson(df.schema.jsonValue())).parquet(path)

    def upsert(self, file: DataFrame) -> UpdateReport:
        """One file, whatever its time, under the recorded profile."""
        record = self.require_profile()
        later = file.withColumn("file_modified_at", F.greatest("file_modified_at", F.lit("1970-01-01").cast("timestamp")))
        self._commit({"indexed_files": (None, later.select("file_path"))})
        return self.update(later, record.alias, record.chunk_size, record.chunk_overlap, allow_removal=False)

    def _log(self, profile: Profile, r: UpdateReport) -> None:
        entry = {
            "schemaVersion": 1, "timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "embedder": profile.embedder, "profile": profile.identity, "wallSeconds": r.wall_seconds,
            "filesScanned": r.files_scanned, "added": r.added, "updated": r.updated, "removed": r.removed, "unchanged": r.unchanged,
            "skippedUnreadable": r.skipped_unreadable, "skippedEmbedFailures": r.skipped_embed_failures, "partialEmbedFailures": r.partial_embed_failures,
        }
        append_log(self.files, f"{self.path}/log.jsonl", json.dumps(entry))

    def log(self) -> DataFrame:
        from cairn.schema import LOG

        path = f"{self.path}/log.jsonl"
        return self.spark.read.schema(LOG).json(path) if self.files.exists(path) else self.spark.createDataFrame([], LOG)

    # queries

    def search(self, query: str, limit: int = 10, glob: str | None = None, min_lines: int | None = None, with_ordinals: bool = False, with_metadata: bool = False) -> DataFrame:
        """Files by their best chunk; an incomplete file's chunks are found like any."""
        profile = self.require_profile()
        vector = list(embed_query(query, profile))
        chunks = self.chunks.select("id", "file_path", "line_start", "line_end", "chunk_type", "page_number", "content_preview", "embedding")
        meta = self.indexed_files if with_metadata or min_lines is not None else None
        return se.search(chunks, vector, limit, meta, glob, min_lines, with_ordinals=with_ordinals, match=["chunk_type", "line_start", "line_end", "page_number", "content_preview"])

    def chunk(self, path: str, index: int) -> DataFrame:
        return se.fetch_nth(self.chunks.drop("ordinal"), path, index)

    def describe(self) -> dict:
        c = self.config()
        return {"name": self.name, "source": c.source_directory, "profile": asdict(c.profile) if c.profile else None, "files": self.indexed_files.count(), "chunks": self.chunks.count()}

    def size_in_bytes(self) -> int:
        return self.files.size(self.path)

    def sweep(self, files: DataFrame, sizes: list[int], percents: list[int], rubric, alias: str = DEFAULT_ALIAS) -> DataFrame:
        """Every grid point is indexed, asked the rubric's queries and scored: ``ordinal, size, overlap, total, either, both``."""
        from cairn.operators import evaluate as ev

        grid = ev.grid(self.spark, sizes, percents)
        results = None
        for p in grid.collect():  # each point is an index of its own
            self.reset().update(files, alias, p.size, p.overlap)
            profile = self.require_profile()
            hits = se.top_k(self.chunks.select("id", "file_path", "embedding"), {n: list(embed_query(q, profile)) for n, q in rubric.queries}, 60)
            best = hits.groupBy("query_id", "file_path").agg(F.max(1 - F.col("distance")).alias("s"))
            w = F.row_number().over(se.Window.partitionBy("query_id").orderBy(F.desc("s"), "file_path"))
            own = self._kept(best.select(F.lit(p.ordinal).alias("point"), F.col("query_id").alias("query"), w.alias("rank"), F.col("file_path").alias("file")).where("rank <= 20"), "sweep")
            results = own if results is None else results.unionByName(own)
        targets = self.spark.createDataFrame([(t, t) for t in rubric.targets], "target string, file string")
        return grid.join(ev.totals(ev.points(ev.target_ranks(results, targets), rubric), rubric), grid.ordinal == F.col("point")).drop("point").orderBy("ordinal")


def append_log(files: Files, path: str, line: str, kept: int = LOG_KEPT) -> None:
    """The last lines and one more; old lines are kept as they are, so fields unknown here survive."""
    old = files.read(path).splitlines() if files.exists(path) else []
    files.write(path, "\n".join([*old[-(kept - 1) :], line]) + "\n")
