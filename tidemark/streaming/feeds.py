"""Sources and runs of streaming queries: folders that files are dropped into, with a cap on what a trigger takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.sinks import scratch

#: Chunks of audio as a device sends them.
CHUNKS = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])


def dropped(rows: DataFrame, folder: str, order: str, parts: int = 4) -> None:
    """Write rows (stream_id and more) as a device would: `parts` drops that go on in `order`, a stream whole within each."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        rows.write.mode("append").parquet(folder)
        return
    part = F.floor((F.col(order) - low) * parts / (high - low + 1))
    for i in range(parts):
        rows.where(part == i).repartition("stream_id").write.mode("append").parquet(folder)


def folder_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first, so many files a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_through(found: DataFrame) -> DataFrame:
    """Run a streaming query until its source has no more, in as many triggers as its cap asks for; its rows.

    A failure raises StreamingQueryException, which names the folder's query; the rows of the triggers done
    before are in the folder by then.
    """
    spark = found.sparkSession
    folder = scratch(spark, "stream")
    query = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")
