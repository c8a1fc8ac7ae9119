"""Near-duplicate detection: ProbMinHash signatures, banding, verification, classes.

A document is its weighted set of five-word shingles: one that occurs n times weighs 1 + ln n. In the
signature each shingle of weight w is a Poisson process of rate w whose arrivals fall on random components;
a component keeps the shingle that arrives first. Two signatures agree in a component with the probability
Jaccard similarity of the two weighted sets. Arrivals are drawn in order of time and stop once none can be
first any more.

Two documents are linked where the exact probability Jaccard similarity of their weighted shingles is at
least the threshold, or that of equal weights, which is the Jaccard similarity of the plain sets. Documents
with repeated shingles are signed with both weightings, so that every pair that is a link by either measure
meets by the measure it is a link by; for all others the two signatures are one.

Copies (equal words) are one node from the start. Nodes that agree in a whole band are candidates. A
bucket never gives all its pairs: its members are first held against two hubs; what the verified links
leave apart, bucket by bucket, is compared through an exact prefix filter over the rarest shingles, which
loses no pair at the threshold by either measure. Classes are the connected components of the links. Keys
that many rows share (buckets, hubs, star centres, shingles) are joined apart from the rest.

Words are runs of letters and digits in lower case. Texts of one to four words are one shingle. Texts
without a word, nulls included, are copies of each other. Repeated rows and ids are fine; further columns
take no part. Every input row gives one output row, an empty table none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, lean, map_rows, materialise

#: Words of a shingle, similarity of a link, signature length, bands and rows of the banding.
WIDTH, THRESHOLD, LENGTH, BANDS, ROWS = 5, 0.8, 256, 36, 7
#: The constants of the splitmix64 generator.
GAMMA, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_word = re.compile(r"[^\W_]+").findall
_hashes: dict[str, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _word((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, looked up in a cache of bounded size."""
    if len(_hashes) > 200_000:
        _hashes.clear()
    get = _hashes.get
    out = [get(w) for w in words]
    for i, h in enumerate(out):
        if h is None:
            w = words[i]
            _hashes[w] = out[i] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(out, np.uint64)


def shingles(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        total = mixed(total + GAMMA + h[i : i + n])
    return np.unique(total, return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each component the shingle whose Poisson process arrives there first."""
    first, owner = np.full(length, np.inf), np.zeros(length, np.uint64)
    time, drawn, active = np.zeros(len(keys)), 0, np.arange(len(keys))
    target = 1.2 * length * np.log(length)
    while len(active):
        steps = int(min(256, max(2, -(-target // len(active)))))
        key = keys[active]
        bits = mixed(key[:, None] + (np.arange(drawn + 1, drawn + steps + 1, dtype=np.uint64) * GAMMA)[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active][:, None]
        times = time[active][:, None] + np.cumsum(gaps, axis=1)
        where = (bits & np.uint64(length - 1)).astype(np.int64)
        better = times < first[where]
        t, c = times[better], where[better]
        k = np.broadcast_to(key[:, None], times.shape)[better]
        order = np.argsort(-t)
        first[c[order]], owner[c[order]] = t[order], k[order]
        time[active] = times[:, -1]
        drawn += steps
        active = active[time[active] < first.max()]
    return owner


def band_hashes(owner: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    grid = owner[: bands * rows].reshape(bands, rows)
    total = np.arange(bands, dtype=np.uint64) * MIX1
    for i in range(rows):
        total = mixed(total + GAMMA + grid[:, i])
    return total.view(np.int64)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Weights of shingles that occur so often."""
    return 1.0 + np.log(counts)


def estimate(one: np.ndarray, other: np.ndarray) -> float:
    """The probability Jaccard similarity that two signatures make likely: the share of components that agree."""
    return float((one == other).mean())


def probability_jaccard(keys_a: np.ndarray, a: np.ndarray, keys_b: np.ndarray, b: np.ndarray) -> float:
    """The exact similarity of two weighted sets: the sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d).

    In order of b_e / a_e the maximum is a_e / a_d up to d and b_e / b_d after it, so running sums suffice.
    """
    if not len(keys_a) or not len(keys_b):
        return float(not len(keys_a) and not len(keys_b))
    keys, at = np.unique(np.concatenate((keys_a, keys_b)), return_inverse=True)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[at[: len(keys_a)]], y[at[len(keys_a) :]] = a, b
    ratio = np.divide(y, x, out=np.full(len(keys), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    first = np.searchsorted(ratio, ratio, side="right")
    upto, after = np.concatenate(([0], np.cumsum(x)))[first], np.concatenate((np.cumsum(y[::-1])[::-1], [0]))[first]
    both = (x > 0) & (y > 0)
    return float((1 / (upto[both] / x[both] + after[both] / y[both])).sum())


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("repeats", T.BooleanType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])
#: A key counts as very frequent from so many rows and such a share of all rows on: 1,000 keys at most. Tasks for each.
HOT_ROWS, HOT_SHARE, SALTS = 256, 0.001, 32
#: Nodes whose texts are fetched by a join that is sent to every executor, at most.
SEND = 500_000


def node_key(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, length: int = LENGTH) -> DataFrame:
    """doc_id, the key of its words, its number of distinct shingles, whether any repeats, and its band hashes."""

    def make():
        def work(cols: dict) -> dict:
            out: dict = {n: [] for n in SIGNED.names}
            done: dict[bytes, tuple] = {}  # copies in the same batch are signed once
            for doc, text in zip(cols["doc_id"], cols["text"]):
                words = words_of(text)
                key = node_key(words)
                if key not in done:
                    keys, counts = shingles(words, width)
                    repeats = bool((counts > 1).any())
                    own = [np.ones(len(keys)), *([weighted(counts)] if repeats else [])] if len(keys) else []
                    found = {b for w in own for b in band_hashes(signature(keys, w, length), bands, rows).tolist()}
                    done[key] = (len(keys), repeats, sorted(found))
                for n, v in zip(SIGNED.names, (doc, key, *done[key])):
                    out[n].append(v)
            return out

        return work

    return map_rows(docs.select("doc_id", "text"), make, SIGNED)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, size, repeats, grams and, where any repeats, counts of the nodes in `wanted` (node, key, rep): the texts of their first documents, shingled."""
    none = F.lit(-(2**63))
    wanted = wanted.select("node", F.col("key").alias("node_key"), F.coalesce("rep", none).alias("id"))
    few = wanted.count() <= SEND
    rows = docs.select(F.coalesce("doc_id", none).alias("id"), "text").join(F.broadcast(wanted) if few else wanted, "id").drop("id")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("repeats", T.BooleanType()), T.StructField("grams", longs), T.StructField("counts", longs)])

    def run(batches):
        for batch in batches:
            node, grams, counts = [], [], []
            for n, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "node_key", "text"))):
                words = words_of(text)
                if node_key(words) == key:
                    keys, often = shingles(words, width)
                    node.append(n)
                    grams.append(keys.view(np.int64))
                    counts.append(often if (often > 1).any() else None)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(list(map(len, grams)), pa.int32()), pa.array([c is not None for c in counts], pa.bool_()), pa.array(grams, many), pa.array(counts, many)], names=schema.names)

    return rows.mapInArrow(lean(run), schema).dropDuplicates(["node"])


def apart(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table (key once each, n of the rows that have it): the rows of a very frequent key are dealt to SALTS tasks.

    The n add up to `total` at most, so there are at most 1 / HOT_SHARE such keys to be told to every task.
    """
    many = F.col("n") >= max(HOT_ROWS, int(total * HOT_SHARE))
    told = F.broadcast(table.where(many).select(key, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(told, key, "left").withColumn("__salt", salt).drop("__hot")
    spread = table.withColumn("__salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "__salt"]).drop("__salt")


def alike(common: Column, one: Column, other: Column, tenths: int) -> Column:
    """common / (one + other - common) >= tenths / 10, in integers."""
    return common * (10 + tenths) >= (one + other) * tenths


def verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b, repeats) that are links, by their sets or, where either repeats a shingle, by the weighted sets."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    plain = joined.where(alike(F.size(F.array_intersect("grams_a", "grams_b")), F.col("size_a"), F.col("size_b"), tenths)).select("a", "b")
    names = ("grams_a", "counts_a", "grams_b", "counts_b")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("grams").alias(f"grams_{s}"), F.col("counts").alias(f"counts_{s}"))
    some = pairs.where("repeats").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", *names)

    def run(batches):
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                keys_a, counts_a, keys_b, counts_b = (batch.column(n)[i].values.to_numpy() if batch.column(n)[i].is_valid else None for n in names)
                x, y = (weighted(c) if c is not None else np.ones(len(k)) for k, c in ((keys_a, counts_a), (keys_b, counts_b)))
                if probability_jaccard(keys_a, x, keys_b, y) >= tenths / 10 - 1e-12:
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return plain.unionByName(some.mapInArrow(lean(run), "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that an edge (a, b) names: alternating large and small stars."""
    spark = edges.sparkSession
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        total = 2 * (state[0] or 0)
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = apart(both.where("b > a"), least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(apart(edges, least, "a", total).select("a", F.col("m").alias("b")))
        large = materialise(large.where("a <> b").distinct(), "edges")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = apart(large, lowest, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        before, edges = edges, materialise(small.where("a <> b").distinct(), "edges")
        discard(spark, before, large)
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def prefix_pairs(rest: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Pairs (a, b, repeats) of nodes of different classes that can be similar enough: an exact prefix filter.

    rest: node, class. Shingles are ordered from rare to frequent; two sets of the threshold must share one
    within the first places of both, and what follows that place must still suffice. The smaller set needs
    fewer places than the larger, so what is common to very many documents comes into play for few.

    The probability Jaccard similarity is at most the share of either side's weight that is common, so two
    weighted sets of the threshold share a shingle before either has passed the rest of its weight.
    """
    grams = rest.join(sets, "node").select("node", "class", "size", "repeats", F.explode(F.arrays_zip("grams", F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"))).alias("g"))
    grams = grams.select("node", "class", "size", "repeats", F.col("g.grams").alias("gram"), (1 + F.log(F.coalesce("g.counts", F.lit(1)))).alias("w"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    sorted_grams = F.array_sort(F.collect_list(F.struct("n", "gram", (F.col("low") < F.col("high")).alias("mixed"), "w")))
    placed = grams.join(often, "gram").groupBy("node", "class", "size", "repeats").agg(sorted_grams.alias("all"), F.sum("w").alias("mass"))
    size = F.col("size").cast("long")
    probe = size - F.floor((size * tenths + 9) / 10) + 1
    index = size - F.floor((size * 2 * tenths + 9 + tenths) / (10 + tenths)) + 1
    start = F.struct(F.lit(0.0).alias("passed"), F.lit(0).cast("long").alias("places"))
    spare = F.col("mass") * (10 - tenths) / 10 + 1e-9
    passing = F.aggregate("all", start, lambda s, g: F.when(s["passed"] <= spare, F.struct((s["passed"] + g["w"]).alias("passed"), (s["places"] + 1).alias("places"))).otherwise(s))
    places = F.when(F.col("repeats"), F.greatest(probe, passing["places"])).otherwise(probe)
    entries = placed.select("node", "class", "size", "repeats", index.alias("index"), probe.alias("probe"), F.posexplode(F.slice("all", F.lit(1), places.cast("int"))).alias("at", "g")).where("g.mixed")
    entries = materialise(entries.select("node", "class", "size", "repeats", "index", "probe", "at", F.col("g.gram").alias("gram")), "prefixes")
    x, y = entries.where(F.col("at") < F.col("index")).alias("x"), entries.where(F.col("at") < F.col("probe")).alias("y")
    order = (F.col("x.size") < F.col("y.size")) | (F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node"))
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.class") != F.col("y.class")) & order & alike(left, F.col("x.size"), F.col("y.size"), tenths))
    plain = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.repeats") | F.col("y.repeats")).alias("repeats"))
    x, y = entries.where("repeats").alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.class") != F.col("y.class")) & (~F.col("y.repeats") | (F.col("x.node") < F.col("y.node"))))
    heavy = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(True).alias("repeats"))
    return plain.unionByName(heavy).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "repeats").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row."""
    return classified(docs, threshold, width, bands, rows).select("doc_id", "class_id")


def classified(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, the key of its words, the node that names its class and class_id of every row."""
    tenths = round(threshold * 10)
    signs = materialise(signed(docs, width, bands, rows), "signatures")
    nodes = signs.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("repeats").alias("repeats"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    entries = nodes.select("node", "size", "repeats", F.explode("bands").alias("band"))
    # size and repeats of a hub in one number, for the aggregation to stay one of hashes
    about = F.col("size") * 2 + F.col("repeats").cast("int")
    hubs = entries.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.min_by(about, "node").alias("low_about"), F.max("node").alias("high"), F.max_by(about, "node").alias("high_about")).where("n > 1")
    hubs = materialise(hubs, "hubs")
    members = materialise(apart(entries, hubs, "band", total).drop("n"), "members")

    def held(side: str) -> DataFrame:
        other, repeats = F.floor(F.col(f"{side}_about") / 2), F.col("repeats") | (F.col(f"{side}_about") % 2 == 1)
        fits = repeats | (F.least("size", other) * 10 >= F.greatest("size", other) * tenths)
        met = members.where((F.col("node") != F.col(side)) & (F.lit(side == "low") | (F.col("node") != F.col("low"))) & fits)
        return met.select(F.least("node", side).alias("a"), F.greatest("node", side).alias("b"), repeats.alias("repeats"))

    pairs = held("low").union(held("high")).distinct()
    sets = materialise(shingle_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key", "rep"), width), "sets")
    edges = materialise(verified(pairs, sets, tenths), "links")
    classes = materialise(components(edges), "classes")
    known = members.select("band", "node").join(classes, "node", "left").select("band", "node", F.coalesce("root", "node").alias("class"))
    mixed = materialise(known.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("band", "n"), "mixed")
    rest = materialise(apart(known, mixed, "band", total).select("node", "class").distinct(), "rest")
    more = materialise(verified(prefix_pairs(rest, sets, tenths), sets, tenths), "links")
    roots = classes.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not more.isEmpty():
        classes = materialise(components(roots.union(more)), "classes")
    discard(docs.sparkSession, hubs, members, mixed, sets, edges, rest, more)
    named = nodes.select("node", "key", "rep").join(classes, "node", "left").select("key", "rep", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    known = apart(named, least, "root", named.count()).select("key", "root", "class_id")
    copies = signs.groupBy("key").agg(F.count("*").alias("n"))  # a text with very many copies is one key
    return apart(signs.select("doc_id", "key"), known.join(copies, "key"), "key", signs.count()).select("doc_id", "key", "root", "class_id")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with the key of their words in a column `__key`."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())])

    def run(batches):
        for batch in batches:
            keys = [node_key(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class: the least doc_id, null last; of rows that share it, the least key of the words."""
    rows = materialise(classified(docs).select("doc_id", "key", "root"), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"), F.count("*").alias("n"))
    other = apart(rows, first, "root", rows.count()).where("doc_id is not null and (first.doc_id is null or first.doc_id <> doc_id or first.key <> key)").select("doc_id")
    again = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select("doc_id"), "again")
    gone = materialise(other.union(again.where("doc_id is not null")).distinct(), "gone")
    left = docs.where("doc_id is not null").join(F.broadcast(gone) if gone.count() <= SEND else gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    # Rows whose id does not tell them apart are taken by the key of their words.
    some = docs.join(again.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    kept = first.select(F.col("first.doc_id").alias("__first_id"), F.col("first.key").alias("__first_key"))
    some = keyed(some)
    some = some.join(kept, (F.col("__key") == F.col("__first_key")) & F.col("doc_id").eqNullSafe(F.col("__first_id")), "left_semi")
    return left.unionByName(some.dropDuplicates(["__key"]).select(*docs.columns))
