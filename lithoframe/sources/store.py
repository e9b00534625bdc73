"""Small files of a run folder through Hadoop's file system, so a folder may stand in any store that Spark reads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from lithoframe.sources.artifacts import json_safe


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: SHA-256 of what was written here
        self.digests: dict[str, str] = {}
        # An instance of our own: files carry digests of their own, which say more of a changed file than side files do.
        at, conf = spark._jvm.org.apache.hadoop.fs.Path(self.root), spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(at.toUri(), conf)
        self._fs.setWriteChecksum(False)
        self._fs.setVerifyChecksum(False)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._fs, self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return bool(fs.exists(p))

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def write(self, name: str, data: bytes) -> None:
        self.digests[name] = hashlib.sha256(data).hexdigest()
        fs, p = self._at(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(json_safe(value), indent=2, ensure_ascii=False).encode())

    def read_json(self, name: str):
        return json.loads(self.read(name).decode())
