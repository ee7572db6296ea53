"""Shared folders, stored intermediate tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of Arrow data handed to a Python worker at once, if the session names no bound itself.
ARROW_BATCH_BYTES = 8 << 20
#: Bytes of a stored table's values up to which it may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one for the application if all of it runs on this machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        where = _own[app]
    return where.rstrip("/")


_within: ContextVar[str | None] = ContextVar("within", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_within.get() or shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables stored inside go when the block ends; what is to last needs a path made before."""
    path = new_path(spark, name)
    mark = _within.set(path)
    try:
        yield
    finally:
        _within.reset(mark)
        drop_stored(spark, path)


def stored(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, no later step computes it twice, and its shuffle files go at once."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that df is made of, as the optimizer knows them; a source of unknown size counts none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 62)


def drop_stored(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Long texts: a batch for Python ends at so many bytes, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(2**31 - 1))).rstrip("b")) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """small is stored already; it is broadcast if its values are counted few bytes, else both sides are shuffled (skewed keys are split by AQE)."""
    return big.join(F.broadcast(small) if may_broadcast(small) else small.hint("merge"), on, how)


def may_broadcast(small: DataFrame) -> bool:
    """Whether the values of a stored table are counted few bytes."""
    width = sum((_bytes(col(f.name), f.dataType) for f in small.schema.fields), F.lit(0).cast("long"))
    return (small.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        each = kind.elementType
        if isinstance(each, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, each)), F.lit(0).cast("long")) + 16
        size = 16 + 8 * len(each.fields) if isinstance(each, T.StructType) else 8
        return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("long") * size + 16
    return F.lit(8).cast("long")


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names behind a mark that begins no name of ``columns``, so that a user's column is never taken for an inner one."""
    mark, taken = "_", [c.lower() for c in columns]
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
