"""Small files in any store that Spark reads, commits made of them, append-only logs, and folders for what passes."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import CommitConflict, StorageError


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is missing, a temporary folder stands in for it if the master is local; on a cluster no folder of
    one machine would do, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise StorageError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        base = getattr(scratch, "base", None)
        if base is None:
            base = scratch.base = tempfile.mkdtemp(prefix="docframe-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/docframe-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Names below a folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._local = unquote(urlparse(self.root).path) if self._fs.getScheme() == "file" else None

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _disk(self, name: str) -> str:
        return os.path.join(self._local, name)

    def exists(self, name: str) -> bool:
        return os.path.exists(self._disk(name)) if self._local else self._fs.exists(self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        where = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def size(self, name: str) -> int:
        return int(self._fs.getContentSummary(self._path(self.at(name))).getLength())

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file, all of it or nothing; False if there is one.

        The text is written under a name of its own, which then becomes the file's: by a hard link on local disks, else
        by a rename, which must not replace files (as HDFS has it). Neither leaves anything behind that could
        block the name after a crash, and nobody can come in between.
        """
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self._fs.create(self._path(self.at(part)), False)
        try:
            self._io.write(text, out, self._utf8)
        finally:
            out.close()
        try:
            if self._local:
                os.link(self._disk(part), self._disk(name))
                return True
            return not self.exists(name) and bool(self._fs.rename(self._path(self.at(part)), self._path(self.at(name))))
        except (FileExistsError, Py4JJavaError, PySparkException):
            return False
        finally:
            self.delete(part)

    def rename(self, name: str, to: str) -> bool:
        try:
            return bool(self._fs.rename(self._path(self.at(name)), self._path(self.at(to))))
        except (Py4JJavaError, PySparkException):
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def log(self, name: str) -> Log:
        return Log(self, name)


class Log:
    """A new file to which one writer appends lines; a line is on disk when add() returns."""

    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name
        if files._local:
            os.makedirs(os.path.dirname(files._disk(name)), exist_ok=True)
            self._out = open(files._disk(name), "xb", buffering=0)  # noqa: SIM115
        else:
            self._out = files._fs.create(files._path(files.at(name)), False)

    def add(self, *lines: str) -> None:
        """Raises if somebody has taken the file away meanwhile; then it isn't known whether the lines count."""
        text = "".join(f"{line}\n" for line in lines)
        if self.files._local:
            self._out.write(text.encode())
            os.fsync(self._out.fileno())
        else:
            self.files._io.write(text, self._out, self.files._utf8)
            self._out.hsync()
        if not self.files.exists(self.name):
            raise StorageError("another writer has taken over this store")

    def close(self) -> None:
        self._out.close()


@dataclass(frozen=True)
class Commit:
    number: int
    state: dict[str, Any]


class Commits:
    """A chain of snapshots: commit n + 1 can be made once only, by whoever has seen commit n.

    Each commit is whole, so only the last KEEP of them are kept.
    """

    KEEP = 100

    def __init__(self, files: Files, folder: str = "_commits"):
        self.files, self.folder = files, folder

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json")]

    def last(self) -> Commit | None:
        numbers = self._numbers()
        if not numbers:
            return None
        return Commit(max(numbers), json.loads(self.files.read(self._name(max(numbers)))))

    def make(self, after: int, state: dict[str, Any]) -> Commit:
        if not self.files.create(self._name(after + 1), json.dumps(state)):
            raise CommitConflict(f"commit {after + 1} was made by another writer")
        numbers = self._numbers()
        if after not in numbers if after else max(numbers) > 1:  # so late that this commit was made and cleared already
            self.files.delete(self._name(after + 1))
            raise CommitConflict(f"commit {after + 1} was made by another writer long ago")
        for n in numbers:
            if n <= after + 1 - self.KEEP:
                self.files.delete(self._name(n))
        return Commit(after + 1, state)

    def _name(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"
