"""Exact top-k by inner product with no-random-access aggregation.

Candidates are dealt over partitions of bounded bytes and cut into blocks there. Within a block each dimension is a list sorted by
component; a query reads a list from its high end where its own component is positive, from the low end where it is negative, so the
terms come in falling order. After reading all lists to a depth, a candidate's score is bounded below by its read terms plus the lists'
last terms for the others, and above by its read terms plus the terms at the depth reached. Reading goes deeper until no outsider's
upper bound reaches the k-th best score that is sure: the k-th best lower bound in the block, or the k-th best score of the blocks before it
in the partition. A query with few candidates left stops reading; only candidates that are left get their final scores, no others are scored.
Bounds of a block of queries and a block of candidates are matrix products, so nothing is done row by row.

The stated queries meet all candidates in passes of at most `QUERY_BYTES` of queries, which are broadcast; candidates stay where they are,
on disk, for all passes. A partition returns k rows per query, and a ranked merge keeps k. So memory does not grow with the table, and what is
shuffled is each vector once and k rows per query and partition.

Components are floor(scale * x). Scores are exact: products run in double precision where all partial sums fit into
53 bits, and in Python's integers beyond; a score outside the range of a long is clipped to it.

Nulls and ties: a vector that is null, empty, or holds a null or non-finite component takes no part; vectors of
different lengths never meet. Ties go to the smaller id. Rows that repeat an id are candidates each for itself, but no
row of the query's own id is. Query rows that are alike ask once; different vectors under one id share its k places.
An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerflow.llm.common import materialize
from ledgerflow.session import work_dir

SCALE = 256
#: Bytes of the candidates of a block and of a partition, and of the queries of a pass.
BLOCK_BYTES = 2 << 20
PART_BYTES = 32 << 20
QUERY_BYTES = 2 << 20
#: Shares of a list's length at which bounds are compared.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8)
EXACT = 2.0**53
LONG = 2**63


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null if the vector takes no part."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = (F.size(vector) > 0) & F.coalesce(sound, F.lit(False))
    return F.when(usable, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("double")))


class SortedLists:
    """The lists of one block of candidates, one for each dimension, as ranks from the top and from the bottom."""

    def __init__(self, values: np.ndarray):
        self.values = values
        order = np.argsort(values, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(values))[:, None], axis=0)
        self.sorted = np.take_along_axis(values, order, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """Per candidate and dimension the bounds (upper, lower) for queries above zero, then for those below."""
        n = len(self.values)
        high, low = self.rank >= n - depth, self.rank < depth
        from_top, from_bottom = self.sorted[n - depth], self.sorted[depth - 1]
        return (
            np.where(high, self.values, from_top), np.where(high, self.values, self.sorted[0]),
            np.where(low, self.values, from_bottom), np.where(low, self.values, self.sorted[-1]),
        )


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def survivors(queries: np.ndarray, values: np.ndarray, alive: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """The pairs of `alive` whose score can be among the query's k best and reach its `floor`, by reading the lists."""
    lists, up, down = SortedLists(values), np.maximum(queries, 0), np.minimum(queries, 0)
    alive, floor, eligible = alive.copy(), floor.copy(), alive
    # A query without a floor needs k candidates for one.
    undecided = np.flatnonzero((eligible.sum(1) >= k) | (floor > -np.inf))
    for share in DEPTHS:
        if not len(undecided):
            break
        above_up, above_low, below_up, below_low = lists.read(max(1, int(share * len(values))))
        first = undecided[eligible[undecided].sum(1) >= k]
        if len(first):
            lower = up[first] @ above_low.T + down[first] @ below_low.T
            lower[~eligible[first]] = -np.inf
            floor[first] = np.maximum(floor[first], kth_largest(lower, k))
        upper = up[undecided] @ above_up.T + down[undecided] @ below_up.T
        # An outsider that can only tie may still have the smaller id.
        alive[undecided] &= upper >= floor[undecided][:, None]
        undecided = undecided[alive[undecided].sum(1) > 4 * k]
    return alive


class Search:
    """The k best candidates so far of each of some queries of one length; `scored` counts final scores."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.scored = ids, queries, k, 0
        self.best: list[list[tuple[int, object]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, values: np.ndarray) -> None:
        """A block of candidates."""
        alive = self.ids[:, None] != ids[None, :]
        exact = np.abs(self.queries).max(initial=0) * np.abs(values).max(initial=0) * values.shape[1] < EXACT
        if exact and len(ids) > 4 * self.k:
            alive = survivors(self.queries, values, alive, self.floor, self.k)
        for q in np.flatnonzero(alive.any(1)):
            left = np.flatnonzero(alive[q])
            self.scored += len(left)
            if exact:
                total = values[left] @ self.queries[q]
                # Of many only those that can stay are looked at one by one.
                edge = self.floor[q]
                if len(left) > 2 * self.k:
                    edge = max(edge, np.partition(total, len(left) - self.k)[len(left) - self.k])
                left, total = left[total >= edge], total[total >= edge]
            else:
                wide = [int(x) for x in self.queries[q]]
                total = [max(-LONG, min(LONG - 1, sum(a * int(b) for a, b in zip(wide, values[c])))) for c in left]
            found = self.best[q] + [(-int(x), i) for x, i in zip(total, ids[left].tolist())]
            self.best[q] = sorted(found)[: self.k]
            if len(self.best[q]) == self.k:
                # Scores beyond 53 bits are no floor for bounds in double precision.
                last = -self.best[q][-1][0]
                self.floor[q] = last if abs(last) < EXACT else -np.inf

    def results(self) -> Iterator[tuple[object, object, int]]:
        for query, found in zip(self.ids.tolist(), self.best):
            yield from ((query, i, -x) for x, i in found)


def _matrix(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a list of (id, v)."""
    held = rows.values
    vectors = held.field("v")
    return held.field("id").to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, key, score): each query row's k best other rows, fewer if there are fewer."""
    spark, block_bytes = vectors.sparkSession, BLOCK_BYTES
    rows = vectors.select(F.col(key).alias("id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("v IS NOT NULL AND id IS NOT NULL").withColumn("n", F.size("v"))
    rows = materialize(rows, "topk-vectors")
    kind = rows.schema["id"].dataType.simpleString()
    weight = F.coalesce(F.sum(8 * F.col("n").cast("long")), F.lit(0))
    held = rows.agg(weight.alias("all"), F.coalesce(F.sum(F.when(F.col("asks"), 8 * F.col("n").cast("long"))), F.lit(0)).alias("asking")).first()
    passes = max(1, -(-held["asking"] // QUERY_BYTES))
    parts = max(spark.sparkContext.defaultParallelism, -(-held["all"] // PART_BYTES))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(n: int) -> pa.RecordBatch:
            whole = pa.chunked_array(waiting.pop(n)).combine_chunks()
            return pa.record_batch([pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)], ["n", "rows"])

        for batch in batches:
            pairs = pa.StructArray.from_arrays([batch.column("id"), batch.column("v")], ["id", "v"])
            lengths = batch.column("n").to_numpy()
            for n in np.unique(lengths).tolist():
                mine, most = pairs.filter(pa.array(lengths == n)), max(1, block_bytes // (8 * n))
                while len(mine):
                    room = most - sum(map(len, waiting.get(n, [])))
                    waiting.setdefault(n, []).append(mine[:room])
                    mine = mine[room:]
                    if room <= len(waiting[n][-1]):
                        yield block(n)
        for n in list(waiting):
            yield block(n)

    # Only candidates of a length that is asked for.
    lengths = materialize(rows.where("asks").select("n").distinct(), "topk-lengths")
    listed = f"n int, rows array<struct<id:{kind},v:array<double>>>"
    blocks = rows.join(lengths, "n", "left_semi").select("n", "id", "v").repartition(parts).mapInArrow(packed, listed)
    asking = rows.where("asks").select("n", "id", "v").distinct().withColumn("pass", F.pmod(F.xxhash64("id", "v"), F.lit(passes)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Search] = {}
        for batch in batches:
            for n, offered, asked in zip(batch.column("n").to_pylist(), batch.column("rows"), batch.column("asked")):
                if n not in known:
                    known[n] = Search(*_matrix(asked), k)
                known[n].offer(*_matrix(offered))
        for one in known.values():
            found = list(one.results())
            columns = [[f[i] for f in found] for i in range(3)]
            yield pa.record_batch([pa.array(columns[0], id_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())], ["query_id", "id", "score"])

    id_type = to_arrow_type(rows.schema["id"].dataType)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def answered(number: int) -> DataFrame:
        asked = asking.where(F.col("pass") == number).groupBy("n").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
        # At most about `QUERY_BYTES`.
        local = blocks.join(F.broadcast(asked), "n").mapInArrow(search, f"query_id {kind}, id {kind}, score long")
        return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if passes == 1:
        ranked = answered(0)
    else:
        blocks = blocks.persist(StorageLevel.DISK_ONLY)
        folder = work_dir(spark, "topk-passes")
        for number in range(passes):
            answered(number).write.parquet(f"{folder}/pass={number}")
        blocks.unpersist()
        # Different vectors under one id may have been asked in different passes.
        found = spark.read.parquet(*[f"{folder}/pass={number}" for number in range(passes)]).drop("rank")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
