"""Small files on whatever file system Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return [str(s.getPath()) for s in self._fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """Writes a new file beside the old one, then takes its place."""
        new, at = self._path(f"{name}.new"), self._path(name)
        out = self._fs.create(new, True)
        out.write(bytearray(data))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self._gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, at, flags)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
