"""Token counts of documents in flat, unindexed token files: separator scan.

A token file is nothing but little-endian unsigned 16-bit ids; an end id closes every document. Files are
cut into blocks of fixed size without regard to documents. Each block is searched for the end id in one
vectorised comparison; a document that began in an earlier block gets its start from a prefix scan over
the blocks' summaries (ends so far, place of the last end), a few numbers a block.

A file's rest without an end is a document of its own, marked open. An empty file has no documents. A
trailing odd byte is no id and is passed over. Null texts are documents of no tokens; repeated rows and ids
are documents of their own; an empty table writes no files and gives no rows.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import encoded, transducer
from tidemark.llm.common import fresh_path, materialise

#: Bytes of an id and of a block.
WIDTH, BLOCK_BYTES = 2, 16 << 20

WRITTEN = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_no", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("bytes", T.LongType())])
FOUND = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("in_block", T.LongType()), T.StructField("end", T.LongType()), T.StructField("before", T.LongType()), T.StructField("closed", T.BooleanType())])


def opened(url: str):
    """File system and path of a URL; executors reach the shared folder by Arrow's own file systems."""
    from pyarrow import fs

    plain = url.removeprefix("file:") if url.startswith("file:") and not url.startswith("file://") else url
    return fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")


def check_ids(tokenizer: str, end_id: int) -> None:
    """Raise where an id does not fit, or where the end id could stand inside a document."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["id"] for t in spec.get("added_tokens", [])}
    ids = set(spec["model"]["vocab"].values()) | added
    for i in (end_id, max(ids)):
        if not 0 <= i < 1 << 8 * WIDTH:
            raise ValueError(f"id {i} does not fit into {8 * WIDTH} bits")
    if end_id in ids - added:
        raise ValueError(f"id {end_id} is an ordinary token and cannot end a document")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """One token file a task; returns file, doc_no, doc_id and the file's bytes so far, a row a document.

    Ids and `end_id` must fit into 16 bits and `end_id` must be no id of a text, else nothing is written:
    ValueError. A task that runs again writes a file of another name, and only the files of the rows returned count.
    """

    check_ids(tokenizer, end_id)

    def run(batches):
        t = transducer(tokenizer, special_in_text=False)
        system, base = opened(folder)
        name = f"part-{uuid.uuid4().hex}.u16"
        system.create_dir(base, recursive=True)
        end, number, size = end_id.to_bytes(WIDTH, "little"), 0, 0
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                rows = []
                for key, blocks in zip(batch.column("doc_id").to_pylist(), encoded(t, batch.column("text").to_pylist())):
                    for block in blocks:
                        size += out.write(np.frombuffer(block, "<u4").astype("<u2").tobytes())
                    size += out.write(end)
                    rows.append((f"{folder}/{name}", number, key, size))
                    number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=WRITTEN.names)

    return docs.select("doc_id", "text").mapInArrow(run, WRITTEN)


def scan_blocks(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files: file, bytes. One row for each end that a block holds, and for the open rest of a file."""
    last = F.greatest(F.floor((F.col("bytes") - 1) / block_bytes), F.lit(0))
    blocks = files.where(F.col("bytes") >= WIDTH).select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))

    def run(batches):
        for batch in batches:
            for file, size, block in zip(*(batch.column(n).to_pylist() for n in ("file", "bytes", "block"))):
                system, path = opened(file)
                at = block * block_bytes
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size // WIDTH * WIDTH - at), at), "<u2")
                ends = np.flatnonzero(ids == end_id) + at // WIDTH
                total = size // WIDTH
                open_rest = at // WIDTH + len(ids) == total and len(ids) and ids[-1] != end_id
                if open_rest:
                    ends = np.append(ends, total)
                n = len(ends)
                if n:
                    before = pa.array([None, *ends[:-1].tolist()], pa.int64())
                    closed = pa.array([*[True] * (n - 1), not open_rest])
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(np.arange(n)), pa.array(ends, pa.int64()), before, closed], names=FOUND.names)

    return blocks.repartition(F.xxhash64("file", "block")).mapInArrow(run, FOUND)


def stitch(found: DataFrame) -> DataFrame:
    """file, doc_no, start, n_tokens, closed: block-local ends joined to the prefix scan over blocks."""
    blocks = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_no"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"))
    start = F.coalesce("before", "carry") + 1
    return found.join(scan, ["file", "block"]).select("file", (F.col("first_no") + F.col("in_block")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), "closed")


def count_tokens(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return stitch(materialise(scan_blocks(files, end_id, block_bytes), "ends"))


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, doc_no, start, n_tokens: writes the documents' token files, then counts by the files alone."""
    folder = fresh_path(docs.sparkSession, "tokens")
    written = materialise(write_token_files(docs, tokenizer, folder, end_id), "manifest")
    files = written.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return count_tokens(files, end_id, block_bytes).join(written.select("file", "doc_no", "doc_id"), ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
