"""A store of versions that survives failed writes, and a log of appended reports.

Rows are written aside, read back and counted, and only then published by one
marker file that is moved into place; a marker names its folder. The move fails where the marker
exists, so of two writers that started from one version the second is told.
Readers follow markers only: what a failed write leaves behind is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Someone else published this version meanwhile."""


class _Published:
    """Folders of rows that markers publish, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        context = spark.sparkContext
        self._fs = context._jvm.org.apache.hadoop.fs
        self._conf = context._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._fs.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self._conf)

    def _markers(self) -> dict[int, str]:
        files, folder = self._files(), self._at("published")
        if not files.exists(folder):
            return {}
        return {int(s.getPath().getName()): s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().isdigit()}

    def _content(self, marker: str) -> dict:
        return json.loads(self.spark.read.text(marker, wholetext=True).first()[0])

    def _folder(self, marker: str) -> str:
        return self._content(marker)["folder"]

    def _written(self, df: DataFrame) -> str:
        """The folder of rows that could be read again."""
        if df.schema.simpleString() != self.schema.simpleString():
            df = df.select(*[df[f.name].cast(f.dataType) for f in self.schema.fields])
        folder = f"rows/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        wrote, found = df.count(), self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        if wrote != found:
            raise OSError(f"{found} of {wrote} rows can be read from {self.path}/{folder}")
        return folder

    def _publish(self, number: int, folder: str, **more) -> None:
        aside = self._at("aside", uuid.uuid4().hex)
        out = self._files().create(aside, False)
        out.write(bytearray(json.dumps({"folder": folder, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **more}).encode()))
        out.close()
        self._files().mkdirs(self._at("published"))
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(self._fs.Options.Rename, 0)
        target = self._at("published", f"{number:012d}")
        try:
            self._fs.FileContext.getFileContext(self._at().toUri(), self._conf).rename(aside, target, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            raise Conflict(f"{self.path} has a version {number} already") from None


class Store(_Published):
    """One table in versions; the last one published counts."""

    def version(self) -> int:
        """The number of the last version; 0 if there is none."""
        return max(self._markers(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, by default the last one's; none before the first."""
        markers = self._markers()
        version = max(markers, default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(markers[version])}")

    def publish(self, df: DataFrame, expected: int) -> int:
        """Make ``df`` the version after ``expected``; ``Conflict`` if that one isn't the last any more."""
        if self.version() != expected:
            raise Conflict(f"{self.path} is at version {self.version()}, not {expected}")
        self._publish(expected + 1, self._written(df))
        return expected + 1

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> DataFrame:
        """Publish what ``change`` makes of the last version, from anew where another writer was first; the rows as published."""
        for left in reversed(range(tries)):
            seen = self.version()
            try:
                return self.read(self.publish(change(self.read(seen)), seen))
            except Conflict:
                if not left:
                    raise

    def prune(self, keep: int = 2) -> None:
        """Delete the folders of all versions but the last ones, and what failed writes left aside. Not while others write."""
        markers = self._markers()
        kept = sorted(markers)[-keep:]
        folders = {self._folder(markers[n]).rsplit("/", 1)[1] for n in kept}
        files = self._files()
        for n in sorted(markers)[:-keep]:
            files.delete(self._fs.Path(markers[n]), False)
        if files.exists(self._at("rows")):
            for s in files.listStatus(self._at("rows")):
                if s.getPath().getName() not in folders:
                    files.delete(s.getPath(), True)
        files.delete(self._at("aside"), True)


class Log(_Published):
    """Rows that are only appended, a segment at a time; all published segments count."""

    def append(self, df: DataFrame, tries: int = 20) -> int:
        """Publish a segment under the next free number."""
        folder = self._written(df)
        for left in reversed(range(tries)):
            number = max(self._markers(), default=0) + 1
            try:
                self._publish(number, folder)
                return number
            except Conflict:
                if not left:
                    raise

    def _live(self) -> dict[int, str]:
        """Numbers and folders of the segments that no compacted one stands for."""
        segments = {n: self._content(m) for n, m in self._markers().items()}
        replaced = {n for s in segments.values() for n in s.get("replaces", ())}
        return {n: s["folder"] for n, s in segments.items() if n not in replaced}

    def read(self) -> DataFrame:
        """The rows of all segments, in one scan."""
        folders = [f"{self.path}/{f}" for f in self._live().values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def compact(self, tries: int = 20) -> None:
        """Write all segments as one and publish it in place of them; others may append meanwhile."""
        live = self._live()
        if len(live) < 2:
            return
        folder = self._written(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in live.values()]))
        for left in reversed(range(tries)):
            try:
                return self._publish(max(self._markers()) + 1, folder, replaces=sorted(live))
            except Conflict:
                if not left:
                    raise
