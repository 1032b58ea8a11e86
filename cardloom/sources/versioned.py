"""Tables published together: every version is a list of folders, and readers see a version whole or not at all.

Tables are written to folders of their own.  Only then is the version's list written beside its final name and renamed
to it, which one writer of a version number can do, so a writer that stops in between leaves the version before it in place,
and of two writers one fails.  Nothing is overwritten; `vacuum` deletes folders that no kept version lists.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    """A version's number and each table's folders, oldest first."""

    number: int
    tables: dict[str, list[str]]


class _Files:
    """Small files of any file system that Spark's Hadoop libraries know."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The file appears with all its text, or, if there is one of that name, not at all."""
        part = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self._conf)
        context.rename(self.path(part), self.path(name), SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/_versions"


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version, or None before the first."""
    files = _Files(spark, root)
    numbers = [int(n[:-5]) for n in files.names(_log(root)) if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return None
    return Version(max(numbers), json.loads(files.read(f"{_log(root)}/{max(numbers):020d}.json")))


def publish(root: str, tables: dict[str, DataFrame], add: bool = False, **options: str) -> Version:
    """Write the tables as the next version.  With add their rows join those of the current version, else they take its place; tables that are not named stay.  options are the writer's."""
    spark = next(iter(tables.values())).sparkSession
    last = current(spark, root)
    lists = {} if last is None else {k: list(v) for k, v in last.tables.items()}
    for name, rows in tables.items():
        folder = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
        rows.write.options(**options).parquet(folder)
        lists[name] = [*(lists.get(name, []) if add else []), folder]
    version = Version(0 if last is None else last.number + 1, lists)
    _Files(spark, root).create(f"{_log(root)}/{version.number:020d}.json", json.dumps(lists))
    return version


def read(spark: SparkSession, root: str, table: str, version: Version | None = None) -> DataFrame:
    """The rows of one table of a version (the newest)."""
    found = version or current(spark, root)
    if found is None or table not in found.tables:
        raise ValueError(f"no version of {table} below {root}")
    return spark.read.parquet(*found.tables[table])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete what the `keep` newest versions do not list, such as what stopped writers left; the folders deleted.  No writer may be at work."""
    files, newest = _Files(spark, root), current(spark, root)
    if newest is None:
        return []
    lists = [n for n in files.names(_log(root)) if n.endswith(".json")]
    used = {folder for n in lists[-keep:] for folders in json.loads(files.read(f"{_log(root)}/{n}")).values() for folder in folders}
    gone = [f"{_log(root)}/{n}" for n in files.names(_log(root)) if n not in lists[-keep:]]
    for table in newest.tables:
        own = f"{root.rstrip('/')}/{table}"
        gone += [f"{own}/{n}" for n in files.names(own) if f"{own}/{n}" not in used]
    for name in gone:
        files.delete(name)
    return gone


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below the cluster's shared one (or the warehouse, if that is not named)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(folder or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"


def cut(rows: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder that the session names; into the warehouse only where none is named (tests)."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(own_folder(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()
