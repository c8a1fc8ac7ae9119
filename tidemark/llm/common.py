"""Shared plumbing of the training-data operators: shared-folder tables and Arrow mapping."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one in local mode; on a cluster that is an error, as executors would not
    see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, target = _place(spark, path)
    system.deleteOnExit(target)
    return path


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            system, target = _place(spark, file)
            system.delete(target.getParent(), True)


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches where the session has Spark's default: ten thousand documents are too many to hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives back what memory its task no longer uses: workers live on through all stages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return work


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list | None]], schema: T.StructType) -> DataFrame:
    """Map each Arrow batch: `make()` runs once a task and gives a function from column lists to output lists."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow_type(f.dataType)) for n, f in zip(names, schema.fields)], names=names)

    return df.mapInArrow(lean(run), schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
        T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.FloatType: pa.float32(),
    }
    return pa.list_(arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else simple[type(t)]


def parts_for(spark: SparkSession, total_bytes: float, target_bytes: int) -> int:
    """As many partitions as bring each near `target_bytes`, one at least."""
    return max(1, -(-int(total_bytes) // target_bytes))
