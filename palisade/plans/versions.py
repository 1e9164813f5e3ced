"""Numbered versions of stored tables, each number taken by the writer that is first.

A version is one small JSON file that names the data folders in force.  Data are written
first, under names of their own; then the file of the next number is created only if no one
has created it.  Who comes second merges again into what the first one left.  A reader
takes the newest file and sees whole versions only.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from palisade.session import hadoop_path


class VersionLog:
    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.folder = f"{self.path}/versions"

    def _fs(self):
        return hadoop_path(self.spark, self.folder)[0]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        """Numbers that are there, oldest first."""
        found = self._fs().globStatus(self._path(f"{self.folder}/[0-9]*.json")) or ()
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(self._file(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """Number and content of the newest version; -1 and nothing before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def all(self) -> list[tuple[int, dict]]:
        return [(n, self.read(n)) for n in self.numbers()]

    def claim(self, number: int, content: dict) -> bool:
        """Make ``content`` version ``number``; False if that number is taken."""
        fs, draft = self._fs(), self._path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            self._move(fs, draft, self._path(self._file(number)))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)

    def _move(self, fs, draft, target) -> None:
        """Give the draft its name, failing if the name is in use."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        if fs.getUri().getScheme() == "file":  # a hard link is exclusive; a local rename is not
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
            return
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def trim(self, folders_of) -> None:
        """Forget all but the newest ``keep`` versions, and the data folders that only forgotten ones name."""
        versions = self.all()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        used = {f for _, content in kept for f in folders_of(content)}
        fs = self._fs()
        for folder in {f for _, content in old for f in folders_of(content)} - used:
            fs.delete(self._path(folder), True)
        for number, _ in old:
            fs.delete(self._path(self._file(number)), False)
