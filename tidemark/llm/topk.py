"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Candidates lie in cells, and within a cell in clusters of like vectors. A cluster holds, for each dimension,
its vectors in order of that component; a query reads a list from the end where its own component makes the
contribution largest. Once a part of the lists is read, a vector's score lies between the sum of the
contributions met plus, for lists in which it was not met yet, the least contribution of the list (lower
bound) or the contribution at the reading point (upper bound). A vector whose upper bound is below the k-th
best of the exact scores and lower bounds so far is out. No upper bound is below the sum of the
contributions at the reading points, so a query reads on, part by part, until that sum is below its k-th best,
and only then looks at its vectors; reading stops once few are left, and their scores are resolved. Clusters
whose list heads cannot reach a query's k-th best are never read for it.

Queries and candidates meet in cells of one candidate block and one query block, so a task's memory is
constant; each cell passes on at most k rows a query, and the best of these are the answer.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do those with a null
vec_id. Only vectors of the query's length are candidates. A query's own row is left out, other rows of the
same id are not. Ties go to the smaller vec_id. Where integers are too large for exact doubles, scores are
computed with Python integers; one beyond the range of a long is null and ranked by its value as a double.
Further columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidates and queries of a cell; vectors of a cluster; vectors left, times k, that are resolved; parts in which lists are read.
BLOCK, QUERY_BLOCK, CLUSTER, LEFT, PARTS = 4096, 1024, 512, 4, 16
#: Partitions of the cells, at most.
MOST_PARTS = 20_000

OUT = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("size", T.DoubleType())])


@dataclass
class Reads:
    """What a search read: list entries there were, entries read, clusters there were, clusters never read, scores resolved."""

    entries: int = 0
    read: int = 0
    clusters: int = 0
    skipped: int = 0
    resolved: int = 0


class SortedLists:
    """A cluster's vectors with one sorted list a dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(vectors))[:, None], axis=0)

    def reach(self, up: np.ndarray, down: np.ndarray, depth: int) -> np.ndarray:
        """By query the sum of the contributions at the reading points, once `depth` entries of every list are read."""
        return up @ self.sorted[max(0, depth - 1)] + down @ self.sorted[len(self.vectors) - max(1, depth)]

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, queries by vectors, by what is read of the lists."""
        n = len(self.vectors)
        top, end = self.place < depth, self.place >= n - depth
        seen = up @ (self.vectors * top).T + down @ (self.vectors * end).T
        front = (up * self.sorted[depth - 1]) @ (~top).T + (down * self.sorted[n - depth]) @ (~end).T
        least = (up * self.sorted[-1]) @ (~top).T + (down * self.sorted[0]) @ (~end).T
        return seen + least, seen + front

    def left(self, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int, reads: Reads) -> list[np.ndarray]:
        """By query the places of the vectors that can be among the k best, beside the scores already known (k a query, -inf where fewer)."""
        n, dims = self.vectors.shape
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        alive = self.rows[None, :] != own[:, None]
        bars = known.min(1)
        going = np.arange(len(queries))
        for part in range(1, PARTS + 1):
            depth = -(-n * part // PARTS)
            reads.read += len(going) * dims * (depth - -(-n * (part - 1) // PARTS))
            if depth < n:  # an upper bound can be below the bar only where the reading points are
                look = going[(self.reach(up[going], down[going], depth) < bars[going]) | np.isneginf(bars[going]) & (2 * depth >= n)]
            else:
                look = going
            if not len(look):
                continue
            low, high = self.bounds(up[look], down[look], depth)
            low[~alive[look]] = -np.inf
            both = np.concatenate((known[look], low), axis=1)
            bars[look] = np.maximum(bars[look], np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k])
            alive[look] &= high >= bars[look][:, None]
            done = np.zeros(len(queries), bool)
            done[look] = alive[look].sum(1) <= LEFT * k
            going = going[~done[going]]
            if not len(going):
                break
        return [np.flatnonzero(a) for a in alive]


def clusters(vectors: np.ndarray, size: int = CLUSTER) -> list[np.ndarray]:
    """Places of like vectors together, `size` at most: each goes with the likest of a few far apart ones."""
    n = len(vectors)
    if n <= size:
        return [np.arange(n)]
    lengths = np.sqrt((vectors**2).sum(1))
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < 2 * -(-n // size):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    home = (unit @ unit[chosen].T).argmax(1)
    found = []
    for c in range(len(chosen)):
        mine = np.flatnonzero(home == c)
        found += [mine[i : i + size] for i in range(0, len(mine), size)]
    return found


def search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int, reads: Reads | None = None) -> list[list[tuple[int | None, int, float]]]:
    """For each query its k best (score, id, score as a double) of the block, best first."""
    reads = Reads() if reads is None else reads
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    if largest >= 2**52:
        return [_exact(vectors, ids, rows, q, r, k) for q, r in zip(queries, query_rows)]
    found = [SortedLists(vectors[c], ids[c], rows[c]) for c in clusters(vectors)]
    heads, tails = (np.array([c.sorted[i] for c in found]) for i in (0, -1))
    allowed = np.maximum(queries, 0) @ heads.T + np.minimum(queries, 0) @ tails.T
    reads.entries += vectors.size * len(queries)
    reads.clusters += len(found) * len(queries)
    best: list[list[tuple[float, int]]] = [[] for _ in queries]  # (-score, id)
    known = np.full((len(queries), k), -np.inf)
    # the cluster that promises most to a query comes first for it, then the others in common order
    order = np.argsort(-allowed.mean(0), kind="stable").tolist()
    first = allowed.argmax(1)
    turns = [(c, np.flatnonzero(first == c)) for c in range(len(found))] + [(c, np.flatnonzero(first != c)) for c in order]
    for c, asked in turns:
        some = found[c]
        reads.skipped += int((allowed[asked, c] < known[asked].min(1)).sum())
        asked = asked[allowed[asked, c] >= known[asked].min(1)]
        if not len(asked):
            continue
        for i, left in zip(asked.tolist(), some.left(queries[asked], query_rows[asked], known[asked], k, reads)):
            reads.resolved += len(left)
            scores = some.vectors[left] @ queries[i]
            best[i] = sorted([*best[i], *zip((-scores).tolist(), some.ids[left].tolist())])[:k]
            known[i, : len(best[i])] = [-s for s, _ in best[i]]
    return [[(int(-s), i, -s) for s, i in b] for b in best]


def _exact(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int | None, int, float]]:
    q = [int(x) for x in query]
    scored = [(-sum(int(a) * b for a, b in zip(v, q)), int(i)) for v, i, r in zip(vectors, ids, rows) if r != own]
    return [(-s if -(2**63) <= -s < 2**63 else None, i, _double(-s)) for s, i in sorted(scored)[:k]]


def _double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, v array<double>: floor(scale * x) of the vectors that take part."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fits = F.coalesce((F.size("x") > 0) & F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))
    return numbered.where(fits & F.col("vec_id").isNotNull()).select("row", "vec_id", F.transform("x", lambda x: _floor(x * scale)).alias("v"))


def _floor(x):
    """floor as a double, beyond the range of a long too."""
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    rows = scaled(vectors)
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, -(-total // block)), max(1, -(-asked // query_block))
    cell = lambda column, n, seed: F.pmod(F.xxhash64(F.lit(seed), column), F.lit(n)).cast("int")
    every_query_block, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (query_blocks, blocks))
    # a cell is little data and much work: as many partitions as cells, which are not put together by their size
    parts = min(blocks * query_blocks, MOST_PARTS)
    left = rows.withColumn("b", cell(F.col("row"), blocks, 1)).withColumn("q", every_query_block).repartition(parts, "b", "q")
    right = rows.where(F.col("vec_id") % every == 0).withColumn("q", cell(F.col("row"), query_blocks, 2)).withColumn("b", every_block).repartition(parts, "b", "q")

    def run(_, candidates, queries):
        out: dict[str, list] = {n: [] for n in OUT.names}
        for dims in sorted(set(sizes(queries)) & set(sizes(candidates))):
            c_rows, c_ids, c = matrix(candidates, dims)
            q_rows, q_ids, q = matrix(queries, dims)
            for row, query_id, best in zip(q_rows.tolist(), q_ids.tolist(), search(c, c_ids, c_rows, q, q_rows, k)):
                for score, vec_id, size in best:
                    for n, v in zip(OUT.names, (row, query_id, vec_id, score, size)):
                        out[n].append(v)
        return pa.table({n: pa.array(v, pa.float64() if n == "size" else pa.int64()) for n, v in out.items()})

    partial = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(run, OUT)
    order = Window.partitionBy("row").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sizes(table: pa.Table) -> list[int]:
    return pa.compute.list_value_length(table.column("v")).unique().to_pylist()


def matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = table.filter(pa.compute.equal(pa.compute.list_value_length(table.column("v")), dims))
    flat = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return some.column("row").to_numpy(), some.column("vec_id").to_numpy(), flat.reshape(-1, dims)
