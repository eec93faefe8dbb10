"""An optimistic commit log: one file per version, made by create-if-absent.

``<root>/_commits/<version, 20 digits>.json`` holds one JSON object. A writer
reads the latest version, prepares immutable data folders, and then tries to
create the file of the next version. The file system lets exactly one writer
create it; the other gets :class:`CommitConflict` and either gives up or reads
the new state and tries again (:meth:`CommitLog.retrying`). A version file appears whole:
it is written under a temporary name first. On a local file system the last
step is a hard link, which fails when the name exists; elsewhere it is a rename
that does not overwrite, which must be atomic (it is on HDFS; an object store
needs a committer or connector that offers the same).

Only names and single entries pass through the driver, never data.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .warehouse import _hadoop_fs, read_text

FOLDER = "_commits"


class CommitConflict(RuntimeError):
    """Another writer has committed the version this one was about to make."""


class VersionExpired(RuntimeError):
    """The data of a version has been removed by retention."""


def utc_now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` with ``text``; False (and nothing changed) when it exists."""
    fs, hpath, jvm = _hadoop_fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(hpath.getParent(), f".{hpath.getName()}.{os.urandom(8).hex()}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(hpath), local(tmp))
            return True
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(tmp), fs.makeQualified(hpath), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(tmp, False)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{FOLDER}"

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:020d}.json"

    def versions(self) -> list[int]:
        fs, hpath, _ = _hadoop_fs(self.spark, self.path)
        if not fs.exists(hpath):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hpath)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The newest version, 0 when there is none."""
        return max(self.versions(), default=0)

    def entry(self, version: int) -> dict | None:
        """What was committed as ``version``; None when it is missing or unreadable."""
        try:
            found = json.loads(read_text(self.spark, self._file(version)) or "null")
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def commit(self, entry: dict, base: int) -> int:
        """Make version ``base + 1``, or raise when someone else already has."""
        text = json.dumps({**entry, "version": base + 1, "base": base, "committed_at": utc_now()}, sort_keys=True)
        if not create_if_absent(self.spark, self._file(base + 1), text):
            raise CommitConflict(f"version {base + 1} of {self.path} was committed by another writer")
        return base + 1

    def retrying(self, attempt: Callable[[int, dict | None], dict | None], tries: int = 5, wait: float = 0.2) -> int | None:
        """Commit what ``attempt(base, entry of base)`` prepares; after a conflict
        it is prepared anew on the version that won. None from ``attempt``: nothing to do."""
        for turn in range(tries):
            base = self.latest()
            entry = attempt(base, self.entry(base) if base else None)
            if entry is None:
                return None
            try:
                return self.commit(entry, base)
            except CommitConflict:
                if turn == tries - 1:
                    raise
                time.sleep(wait * 2 ** turn)

    def frame(self, schema: str) -> DataFrame:
        """The entries as rows of the given fields (read by the executors)."""
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(self.path)
