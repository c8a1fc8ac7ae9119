"""Sinks: metrics, hop scores, curves, reports, models; and folders that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one in local mode where none is, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that is needed more than once, written below the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def present(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The paths that are there; the others are warned of."""
    there = {name: path for name, path in paths.items() if exists(spark, path)}
    for name in paths.keys() - there.keys():
        warnings.warn(f"{name}: nothing at {paths[name]}", stacklevel=3)
    return there


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file by Hadoop's file systems, written under another name and then put in its place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    system = target.getFileSystem(conf)
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one row of metrics as JSON; infinite numbers as text."""
    row = metrics.first()
    write_text(metrics.sparkSession, path, json.dumps({k: _plain(v) for k, v in row.asDict(recursive=True).items()}, indent=2) + "\n")


def append_metrics(spark: SparkSession, path: str, entry: dict) -> list[dict]:
    """Add an entry to a JSON log, which is written anew as a whole; returns the log."""
    log = [*json.loads(read_text(spark, path) or "[]"), {k: _plain(v) for k, v in entry.items()}]
    write_text(spark, path, json.dumps(log, indent=2) + "\n")
    return log


def _plain(value):
    return str(value) if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))) else value


def write_scores(scores: DataFrame, path: str) -> None:
    """Hop scores (stream_id, hop, score and more) as Parquet, a folder a stream."""
    scores.repartition("stream_id", F.floor(F.col("hop") / (1 << 20))).sortWithinPartitions("stream_id", "hop").write.mode("overwrite").partitionBy("stream_id").parquet(path)


def write_curve(curve: DataFrame, path: str, x: str, y: str, title: str = "") -> int:
    """A curve of a few thousand points at most, such as a DET curve, as an SVG picture; returns the number of points."""
    points = [(float(a), float(b)) for a, b in curve.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(x, F.desc(y)).limit(10_000).collect()]
    points = [(a, b) for a, b in points if abs(a) != float("inf") and abs(b) != float("inf")]
    wide, high = (max((abs(p[i]) for p in points), default=1.0) or 1.0 for i in (0, 1))
    line = " ".join(f"{40 + 540 * a / wide:.2f},{360 - 320 * b / high:.2f}" for a, b in points)
    label = lambda tx, ty, text: f'<text x="{tx}" y="{ty}" font-size="12">{text}</text>'
    axes = '<path d="M40 40V360H580" fill="none" stroke="#888"/>'
    marks = label(40, 20, title) + label(480, 380, f"{x} 0 … {wide:g}") + label(2, 36, f"{y} … {high:g}")
    write_text(curve.sparkSession, path, f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 620 400">{axes}<polyline points="{line}" fill="none" stroke="#06c" stroke-width="2"/>{marks}</svg>\n')
    return len(points)


def report(summary: DataFrame) -> DataFrame:
    """A summary of streams as a table of text, pooled lines last: `show` prints it."""
    number = lambda c, d: F.coalesce(F.format_number(c, d), F.lit("-"))
    return summary.orderBy(F.col("stream_id").isNull(), "kind", "stream_id").select(
        F.coalesce(F.col("stream_id").cast("string"), F.concat(F.lit("all "), F.col("kind"))).alias("set"), F.col("clips").cast("string").alias("clips"),
        F.coalesce(F.concat(number(F.col("miss_rate") * 100, 1), F.lit(" %")), F.lit("-")).alias("missed"), F.coalesce(F.concat(number(F.col("fa_per_clip") * 100, 1), F.lit(" %")), F.lit("-")).alias("fired"),
        F.col("false_accepts").cast("string").alias("false accepts"), number("fa_per_hour", 2).alias("an hour"),
    )


def save_model(spark: SparkSession, path: str, weights: dict[str, list[float]], about: dict) -> None:
    """A linear or small dense model as JSON: weights by name, and what is told about it, such as its threshold."""
    write_text(spark, path, json.dumps({"about": about, "weights": weights}))


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, list[float]], dict]:
    raw = read_text(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    found = json.loads(raw)
    return found["weights"], found["about"]


def resource(spark: SparkSession, name: str, *folders: str) -> str:
    """The first place where a bundled file is: the given folders, then files that were sent to the executors."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder.rstrip('/')}/{name}"
    import os

    from pyspark import SparkFiles

    sent = SparkFiles.get(name)
    if os.path.exists(sent):
        return sent
    raise FileNotFoundError(f"{name} in {', '.join(folders) or 'no folder'}")


def ingest(spark: SparkSession, wanted: dict[str, str]) -> DataFrame:
    """Copy each source to its target where the target is not there yet: target, state (present, copied or the failure).

    Sources are URLs of file systems that Hadoop knows; a failure is told in its row and does not stop the others.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for source, target in wanted.items():
        at, to = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        try:
            system = to.getFileSystem(conf)
            if system.exists(to):
                rows.append((target, "present"))
                continue
            part = jvm.org.apache.hadoop.fs.Path(f"{target}.part")
            jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(conf), at, system, part, False, True, conf)
            rows.append((target, "copied" if system.rename(part, to) else "not put in place"))
        except Exception as e:  # told in the row
            rows.append((target, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "target string, state string")
