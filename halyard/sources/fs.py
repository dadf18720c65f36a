"""Small files through Spark's file systems, local or remote."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileSystem:
    """Text files, listings, atomic replacement and exclusive creation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def scheme(self, path: str) -> str:
        return self._at(path)[0].getScheme()

    def qualified(self, path: str) -> str:
        """The path in full, with its file system."""
        fs, p = self._at(path)
        uri = fs.makeQualified(p).toString()
        return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Creates the file, whole, unless it is there; whether this call did."""
        return self._put(path, text, "NONE")

    def replace(self, path: str, text: str) -> None:
        """Old content or new content, never part of it."""
        self._put(path, text, "OVERWRITE")

    def _put(self, path: str, text: str, mode: str) -> bool:
        """Writes beside the target and renames."""
        hadoop = self._jvm.org.apache.hadoop.fs
        staged = f"{path}.{uuid.uuid4().hex}.tmp"
        self._write(staged, text, True)
        target = hadoop.Path(path)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        context = hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else hadoop.FileSystem.getDefaultUri(conf), conf)
        option = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        option[0] = getattr(hadoop.Options.Rename, mode)
        try:
            context.rename(hadoop.Path(staged), target, option)
            return True
        except Exception:
            self.delete(staged)
            if mode == "NONE" and self.exists(path):
                return False
            raise
