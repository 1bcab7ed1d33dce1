"""Tables that are replaced as a whole: readers see the old version or the new one, never a part of either.

A table is a folder. Every version is a folder in ``data``, written by Spark as usual. A version counts from
the moment its manifest appears in ``versions``: a small file that is written elsewhere and renamed to the next
number, which stores do in one step. The highest number is the pointer; nothing that a reader may use is ever
changed, so a writer that dies at any step leaves the table as it was. Two writers cannot both take a number:
the second one fails, and neither loses a version.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from answerlab.sources.sinks import refuse_overwrite

_DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has replaced the table since this one looked."""


class _Store:
    """The file system of a path, by Hadoop's names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        place = self.path(path)
        self.files = place.getFileSystem(self.conf)
        self.root = self.files.makeQualified(place).toString().rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def list(self, folder: str) -> list[tuple[str, int]]:
        """(name, milliseconds of the last change) of what lies in a folder; nothing where there is none."""
        place = self.path(f"{self.root}/{folder}")
        if not self.files.exists(place):
            return []
        return [(status.getPath().getName(), status.getModificationTime()) for status in self.files.listStatus(place)]

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.path(f"{self.root}/{name}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """In one step, and never onto a file that is there."""
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(f"{self.root}/{old}"), self.path(f"{self.root}/{new}"), none)
        except Py4JJavaError as failure:
            if "FileAlreadyExists" in failure.java_exception.getClass().getName():
                raise Conflict(f"{self.root}/{new} is there already") from failure
            raise

    def remove(self, name: str) -> None:
        self.files.delete(self.path(f"{self.root}/{name}"), True)


def _numbers(store: _Store) -> list[int]:
    names = [name for name, _ in store.list("versions")]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def _manifest(store: _Store, number: int) -> dict:
    return json.loads(store.read(f"versions/{number:0{_DIGITS}d}.json"))


def current_version(spark: SparkSession, table: str) -> int | None:
    """The number of the newest version; None before the first one."""
    numbers = _numbers(_Store(spark, table))
    return numbers[-1] if numbers else None


def read_current(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one of a number that is still kept."""
    store = _Store(spark, table)
    numbers = _numbers(store)
    if not numbers or (version is not None and version not in numbers):
        raise ValueError(f"{table} has no version{'' if version is None else f' {version}'}")
    told = _manifest(store, numbers[-1] if version is None else version)
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{store.root}/{told['folder']}")


def replace_table(frame: DataFrame, table: str, sources: list[str] = (), expected: int | None = None) -> int:
    """Write the frame as the next version and return its number. The frame may be made from the table itself.

    ``expected`` is the version the frame was made from: with it, a version that came in between is a Conflict
    before anything is written as well as after. ``sources`` are other places, which are never written over.
    """
    spark = frame.sparkSession
    refuse_overwrite(spark, table, list(sources))
    store = _Store(spark, table)
    numbers = _numbers(store)
    newest = numbers[-1] if numbers else 0
    if expected is not None and expected != newest:
        raise Conflict(f"{table} is at version {newest}, not {expected}")
    name = uuid.uuid4().hex
    folder = f"data/{newest + 1:0{_DIGITS}d}-{name}"
    frame.write.mode("errorifexists").parquet(f"{store.root}/{folder}")
    told = {"folder": folder, "schema": frame.schema.jsonValue(), "replaces": newest, "written": int(time.time())}
    store.write(f"versions/.{name}.tmp", json.dumps(told))
    store.files.mkdirs(store.path(f"{store.root}/versions"))
    try:
        store.move(f"versions/.{name}.tmp", f"versions/{newest + 1:0{_DIGITS}d}.json")
    except Conflict:
        store.remove(f"versions/.{name}.tmp")
        store.remove(folder)
        raise
    return newest + 1


def remove_old(spark: SparkSession, table: str, keep: int = 2, unfinished_seconds: float = 7 * 24 * 3600) -> list[str]:
    """Remove all but the newest ``keep`` versions, and what dead writers left more than ``unfinished_seconds`` ago.

    Manifests go before their data, so no manifest ever names a folder that is gone. Returns what was removed.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    store = _Store(spark, table)
    numbers = _numbers(store)
    held = {_manifest(store, number)["folder"] for number in numbers[-keep:]}
    gone = []
    old = {}
    for number in numbers[:-keep]:
        old[_manifest(store, number)["folder"]] = number
    for folder, number in old.items():
        store.remove(f"versions/{number:0{_DIGITS}d}.json")
        store.remove(folder)
        gone.append(folder)
    limit = (time.time() - unfinished_seconds) * 1000
    for name, changed in store.list("data"):
        if f"data/{name}" not in held and f"data/{name}" not in old and changed < limit:
            store.remove(f"data/{name}")
            gone.append(f"data/{name}")
    for name, changed in store.list("versions"):
        if name.endswith(".tmp") and changed < limit:
            store.remove(f"versions/{name}")
            gone.append(f"versions/{name}")
    return gone
