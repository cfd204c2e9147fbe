"""Small files of a store (pointers, configuration, log, locks) through Hadoop's file systems, so that any storage will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str | bytes) -> None:
        """By way of another name, which then takes this one's place in one step where the file system can: a reader sees the old or the new file."""
        p, fs = self._path(path)
        part, _ = self._path(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(overwrite.OVERWRITE.getClass(), 1)
        kinds[0] = overwrite.OVERWRITE
        context.rename(context.makeQualified(part), context.makeQualified(p), kinds)

    def create_once(self, path: str, text: str) -> bool:
        """Whether the file was not there and is now ours."""
        p, fs = self._path(path)
        try:
            out = fs.create(p, False)
        except Exception:  # noqa: BLE001 - the JVM's "already exists" in its many shapes
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def size(self, path: str) -> int:
        p, fs = self._path(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
