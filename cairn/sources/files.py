"""Folders of files as tables: scanning, admission by type, ignore rules, texts."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import basename, extension, ignore_patterns, is_ignored, relative_path

SKIPPED = (".git", ".build", ".swiftpm", "node_modules", "__pycache__", ".venv", "venv", "Pods", "DerivedData")
EXTRA_EXTENSIONS = ("ts", "mts", "fish", "graphql", "env", "rst", "org", "jsonl", "jsonc", "cjs")
TEXT_EXTENSIONS = (
    *EXTRA_EXTENSIONS, "txt", "text", "md", "markdown", "csv", "tsv", "json", "xml", "html", "htm", "css", "js", "mjs", "jsx", "tsx", "py", "rb", "rs", "go", "java", "kt", "swift", "c", "h", "cc", "cpp", "hpp", "m", "mm",
    "cs", "php", "pl", "sh", "bash", "zsh", "sql", "yaml", "yml", "toml", "ini", "cfg", "conf", "log", "tex", "r", "lua", "scala", "hs", "el", "lisp", "clj", "vim", "diff", "patch", "plist", "svg", "rtf", "srt",
)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "heic", "webp")
KNOWN_NAMES = (
    "Makefile", "Dockerfile", "Jenkinsfile", "Vagrantfile", "Gemfile", "Rakefile", "Procfile", "Brewfile", "Podfile", "Fastfile", "LICENSE", "README", "CHANGELOG", "AUTHORS", "CONTRIBUTING", ".gitignore", ".editorconfig",
)
SNIFFED = 8192


def not_binary(content: Column) -> Column:
    """No zero byte among the first 8192."""
    return ~F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))


def admitted(path: Column, content: Column) -> Column:
    """Text, PDF and image types and known names; anything else if it does not look binary."""
    known = extension(path).isin(*TEXT_EXTENSIONS, *IMAGE_EXTENSIONS, "pdf") | basename(path).isin(*KNOWN_NAMES)
    return known | not_binary(content)


def in_skipped_folder(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(*SKIPPED))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def git_ignored(root: str, paths: list[str]) -> list[str]:
    """Those of the relative paths that git ignores; none where git or a repository is missing."""
    try:
        done = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(paths).encode(), capture_output=True, check=False)
    except FileNotFoundError:
        return []
    return [p for p in done.stdout.decode().split("\0") if p] if done.returncode in (0, 1) else []


def _hidden_files(spark: SparkSession, root: str) -> DataFrame | None:
    """Files that Spark's own lister leaves out: those with a part that begins with ``.`` or ``_``. A mounted folder is needed to see them."""
    base = Path(root)
    if not base.is_dir():
        return None
    names = []
    for p in base.rglob("*"):
        parts = p.relative_to(base).parts
        if p.is_file() and any(x[0] in "._" for x in parts) and not any(x in SKIPPED for x in parts):
            names.append((str(p),))
    if not names:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [Path(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(p) for p in paths]), pa.array([int(p.stat().st_mtime * 1e6) for p in paths], pa.int64()), pa.array([p.read_bytes() for p in paths], pa.binary())], ["path", "micros", "content"])

    rows = spark.createDataFrame(names, "path string").mapInArrow(read, "path string, micros long, content binary")
    return rows.select("path", F.timestamp_micros("micros").alias("modificationTime"), "content")


def scan(spark: SparkSession, root: str, respect_gitignore: bool = True, include_hidden: bool = False) -> DataFrame:
    """``file_path`` (relative), ``file_modified_at``, ``content`` of the regular files below ``root`` that are admitted, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "content")
    more = _hidden_files(spark, root)
    if more is not None:
        found = found.unionByName(more)
    path = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("path"), "^file:(//)?", ""), r"\+", "%2B"))
    files = found.select(relative_path(path, str(Path(root).resolve()) if Path(root).exists() else root).alias("file_path"), F.col("modificationTime").alias("file_modified_at"), "content")
    files = files.where(~in_skipped_folder(F.col("file_path")))
    if not include_hidden:
        files = files.where(~hidden(F.col("file_path")))
    rules = Path(root) / ".vecignore"
    if rules.is_file():
        files = files.where(~is_ignored(F.col("file_path"), ignore_patterns(rules.read_text())))
    if respect_gitignore and (Path(root) / ".git").exists():
        names = [r.file_path for r in files.select("file_path").toLocalIterator()]  # git wants them all, a partition at a time
        ignored = git_ignored(root, names)
        if ignored:
            files = files.join(spark.createDataFrame([(p,) for p in ignored], "file_path string"), "file_path", "left_anti")
    return files.where(admitted(F.col("file_path"), F.col("content"))).orderBy("file_path")


def one_file(spark: SparkSession, path: str, root: str) -> DataFrame:
    f = spark.read.format("binaryFile").load(path)
    return f.select(relative_path(F.lit(path), root).alias("file_path"), F.col("modificationTime").alias("file_modified_at"), "content")


def texts(files: DataFrame) -> DataFrame:
    """``files`` with ``text`` in place of ``content``: null where the bytes are not UTF-8."""
    return files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).drop("content")


PageReader = Callable[[bytes], "list[str]"]
_READERS: dict[str, PageReader] = {}


def register_reader(kind: str, reader: PageReader) -> None:
    """Plugs in a reader of ``pdf`` pages or of the lines in an ``image``; neither library is shipped."""
    _READERS[kind] = reader


def page_chunks(files: DataFrame, kind: str) -> DataFrame:
    """``file_path, ordinal, chunk_type, text, page_number`` of PDFs (all pages' text first, then each page that is not blank) or images.

    Without a plugged-in reader there is no row, and the files count as unreadable.
    """
    reader = _READERS.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = reader(content) if reader else []
                body = "\n".join(pages).strip()
                if body and kind == "pdf":
                    rows.append((path, 1, "whole", body, None))
                    rows += ((path, n, "pdf_page", t, p) for n, (p, t) in enumerate(((p, t) for p, t in enumerate(pages, 1) if t.strip()), 2))
                elif body:
                    rows.append((path, 1, "image", body, None))
            cols = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)], ["file_path", "ordinal", "chunk_type", "text", "page_number"])

    own = files.where(extension(F.col("file_path")).isin(*(IMAGE_EXTENSIONS if kind == "image" else ("pdf",))))
    return own.select("file_path", "content").mapInArrow(run, "file_path string, ordinal int, chunk_type string, text string, page_number int")
