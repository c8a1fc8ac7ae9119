"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets that fit in memory: a document's shard is a function of its
id and the shard count (law `key`, highest seeded hash wins, so one shard more only takes rows into
itself), its bucket within the shard is drawn from a seeded hash of its position in the input, uniform
whatever the keys are. Pass two puts each bucket into canonical order, shuffles it by Fisher-Yates with a
generator seeded by the bucket, and writes it. Each shard has as many buckets as its own bytes need, so that
one heavy id makes more buckets and not larger ones. A bucket's rows and order do not depend on task order,
so lost tasks can run again; the input must be a scan or a written table, for its positions to hold.

Null texts have size 1 and the checksum of nothing. Null ids are dealt like an id of their own. Repeated
rows keep their number. An empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, materialise, parts_for

SHARDS, SEED, BUCKET_BYTES = 8, 20_240_229, 32 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (seed, shard, key)."""
    marks = F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("mark"), F.lit(s).alias("shard")) for s in range(shards)))
    return F.array_max(marks)["shard"]


def fisher_yates(n: int, seed: str) -> list[int]:
    order = list(range(n))
    draw = random.Random(seed).random
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records with their columns, shard, bucket and place in the bucket, in shuffled order.

    Columns named __shard, __bucket and __place are replaced.
    """
    docs = docs.drop("__shard", "__bucket", "__place")
    own = shard_of(F.col("doc_id"), shards, seed).cast("int")
    sizes = docs.groupBy(own.alias("shard")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("b")).collect()  # a row a shard
    held = {r.shard: parts_for(docs.sparkSession, r.b, bucket_bytes) for r in sizes}
    each = [held.get(s, 1) for s in range(shards)]
    first = [sum(each[:s]) for s in range(shards)]
    of_shard = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("__shard") + 1)
    spot = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), of_shard(each))
    dealt = docs.withColumn("__shard", own).withColumn("__bucket", (of_shard(first) + spot).cast("int"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("__place", T.LongType())])

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        checks = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in table.column("text").to_pylist()]
        keyed = pa.table({"b": table.column("__bucket"), "k": table.column("doc_id"), "c": pa.array(checks, pa.int64())})
        sort = pc.sort_indices(keyed, [("b", "ascending"), ("k", "ascending"), ("c", "ascending")])
        buckets = keyed.column("b").take(sort).to_pylist()
        order, places, at = [], [], 0
        while at < len(buckets):
            end = at
            while end < len(buckets) and buckets[end] == buckets[at]:
                end += 1
            order += [at + i for i in fisher_yates(end - at, f"{seed}/{buckets[at]}")]
            places += range(end - at)
            at = end
        where = sort.take(pa.array(order, pa.int64()))
        for i in range(0, len(order), 1000):
            part = table.take(where[i : i + 1000]).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in part.columns), pa.array(places[i : i + 1000], pa.int64())], names=schema.names)

    return dealt.repartitionById(sum(each), F.col("__bucket")).mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write every shard as Parquet under shard=N/, each bucket's file in shuffled order."""
    external_shuffle(docs, shards, seed).withColumnRenamed("__shard", "shard").drop("__bucket", "__place").write.partitionBy("shard").parquet(path)


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record of the shuffled shards."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()),
        T.StructField("__shard", T.IntegerType()), T.StructField("__bucket", T.IntegerType()), T.StructField("__place", T.LongType()),
    ])

    def make():
        def work(cols: dict) -> dict:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in cols["text"]]
            return cols | {"size": [len(r) + 1 for r in raw], "text_crc32": [zlib.crc32(r) for r in raw]}

        return work

    rows = materialise(map_rows(external_shuffle(docs.select("doc_id", "text"), shards, seed), make, schema), "shards")
    counts = rows.groupBy("__shard", "__bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__bucket", before.alias("start"))
    return rows.join(starts, "__bucket").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("__shard").alias("shard"), (F.col("start") + F.col("__place")).alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
    )
