"""Small helpers around Spark jobs shared by the operators."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Packed rows of one bucket should stay near this size.
BUCKET_BYTES = 8 << 20


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of this application's own only where none is named (tests on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cardloom-checkpoints-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand documents to Python in Arrow batches of at most `rows`, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


#: What modules keep in a worker for speed alone; called to let go of it.
FORGET: list[Callable[[], None]] = []


def release() -> None:
    """Give the memory that a task no longer needs back to the system."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks for the process otherwise
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run` for mapInArrow or applyInArrow, followed by `release`: workers outlive their tasks, and several wait idle beside each busy one."""
    if inspect.isgeneratorfunction(run):

        def task(batches):
            try:
                yield from run(batches)
            finally:
                release()
    elif len(inspect.signature(run).parameters) == 1:

        def task(table):
            try:
                return run(table)
            finally:
                release()
    else:

        def task(left, right):
            try:
                return run(left, right)
            finally:
                release()

    return task


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one scan on the JVM, to size sketches and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def row_key():
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64("doc_id", "text")


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with every column but those used renamed out of the operators' way, and the expressions that restore names and order."""
    names = {c: c if c in used else f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [f"`{new}` AS `{old}`" for old, new in names.items()]
