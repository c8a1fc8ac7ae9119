"""Best-fit packing into sequences: bounded-space online best-fit.

Pieces arrive in a fixed pseudo-random order and are placed one by one as they come. A bitset holds one bit
for each amount of free space that some open bin has; the lowest set bit at or above a piece's length is
the best fit. At most `open_bins` bins are open; where a piece fits none and all are open, the fullest
closes first. A place is final at once, so a packing task keeps its open bins and nothing else, whatever
its input.

Null texts are documents of no tokens; each document ends with one end id. Only documents longer than a
sequence are cut, into whole sequences and one rest. Repeated rows are packed like any others; null ids
stay null; an empty table gives no rows. Columns `sequence_id` and `offset` of `pack`'s input are replaced,
all others pass.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import encoded, transducer
from tidemark.llm.common import lean

#: Tokens of a sequence, bins open at a time, the id that ends a document.
CAPACITY, OPEN_BINS, END_ID = 4096, 256, 1


class OpenBins:
    """The open bins of one packing task."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.made, self.closed = 0, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to `capacity` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            number = self.take(free)
        else:
            if self.count == self.most:
                self.closed += 1
                self.take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        self.count -= 1
        if not bins:
            self.bits ^= 1 << free
        return number


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])
    step, last = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches):
        t = transducer(path)
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []

            def emit(key: int | None, k: int, packed: bytes) -> None:
                doc.append(key)
                piece.append(k)
                start.append(k * capacity)
                length.append(len(packed) // 4)
                crc.append(zlib.crc32(packed))
                if ids:
                    kept.append(np.frombuffer(packed, "<i4"))

            for key, blocks in zip(batch.column("doc_id").to_pylist(), encoded(t, batch.column("text").to_pylist())):
                rest, k = b"", 0
                for block in blocks:
                    rest += block
                    at = 0
                    while len(rest) - at >= step:
                        emit(key, k, rest[at : at + step])
                        at, k = at + step, k + 1
                    rest = rest[at:]
                emit(key, k, rest + last)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if ids else [])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def pack(lengths: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to `capacity`.

    Rows are dealt by a hash of their plain columns and their place in the input, and packed in its order, so
    that many equal rows are spread and a task that runs again packs the same. The number of packing tasks is left to adaptive execution, which joins small ones.
    """
    clash = {"sequence_id", "offset"} & set(lengths.columns)
    rows = lengths.drop(*clash)
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names, order = [f.name for f in rows.schema.fields], "__order"
    while order in names:
        order += "_"

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            spots = [bins.place(n) for n in batch.column("length").to_pylist()]
            new = [pa.array([base + s for s, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=schema.names)

    sortable = [c for c in names if not isinstance(rows.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    keyed = rows.withColumn(order, F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *sortable))
    dealt = keyed.repartition(F.col(order)).sortWithinPartitions(order, *sortable)
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents; with `ids`, the training sequences' contents come along."""
    return pack(pieces(docs, path, ids=ids))
