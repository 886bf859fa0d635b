"""Exact top-k inner products: a KD-tree for each shard, queries in blocks."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from waymill.llm.common import materialise, scratch_path, tidied

SHARD_ROWS = 16_384
LEAF_ROWS = 128
#: Queries that are sent to the executors at once: at 64 components 8 MB.
BLOCK_QUERIES = 16_384
EXACT = float(1 << 53)


class KDTree:
    """Median splits along the widest axis; tight boxes around what each node holds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        self.leaf = np.zeros(len(ids), dtype=np.int32)  # of each row
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            at, parent, side = stack.pop()
            node = len(self.kids)
            if parent >= 0:
                pair = self.kids[parent]
                self.kids[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            box = self.rows[at]
            lo, hi = box.min(axis=0, initial=np.inf), box.max(axis=0, initial=-np.inf)
            self.lo.append(lo)
            self.hi.append(hi)
            if len(at) <= leaf_rows or not (hi > lo).any():
                self.kids.append(None)
                self.members.append(np.sort(at))
                self.leaf[at] = node
                continue
            axis = int(np.argmax(hi - lo))
            half = len(at) // 2
            split = at[np.argpartition(box[:, axis], half)]
            self.kids.append((-1, -1))
            self.members.append(None)
            stack += [(split[half:], node, 1), (split[:half], node, 0)]
        self.lo_matrix, self.hi_matrix = np.array(self.lo), np.array(self.hi)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each query its k best (score, id), best first, but none below floor.

        own: the query's id; one row of this id and of the query's vector is the query itself and is left out. Nodes are opened best bound first;
        one whose bound is under the k-th score so far (or floor) is never opened.
        """
        found = []
        if not len(self.ids):
            return [[] for _ in queries]
        bounds = np.maximum(queries, 0) @ self.hi_matrix.T + np.minimum(queries, 0) @ self.lo_matrix.T
        first, last = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        for q, least, bound, a, b in zip(queries, floor, bounds, first.tolist(), last.tolist(), strict=True):
            best: list[tuple[float, int]] = []  # a heap of (score, -id): its head is the worst
            itself = a + np.flatnonzero((self.rows[a:b] == q).all(axis=1))[:1] if b > a else ()
            home = int(self.leaf[itself[0]]) if len(itself) else -1
            line = [(-bound[0], 0)]
            while line:
                ahead, node = heapq.heappop(line)
                if -ahead < least:
                    break
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if bound[kid] >= least:
                            heapq.heappush(line, (-bound[kid], kid))
                    continue
                at = self.members[node]
                scores = self.rows[at] @ q
                near = np.flatnonzero(scores >= least)
                if node == home:
                    near = near[at[near] != itself[0]]
                if len(near) > 4 * k:
                    near = near[np.lexsort((self.ids[at[near]], -scores[near]))[:k]]
                for j in near:
                    entry = (float(scores[j]), -int(self.ids[at[j]]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
            found.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return found


_RESULT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_SHARD = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("largest", pa.float64()), ("tree", pa.binary())])


def _plant(table: pa.Table) -> pa.Table:
    """One row for each shard: its tree over floor(scale * x) as doubles, and the largest component."""
    flat = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float64)
    tree = KDTree(np.asarray(table.column("id"), dtype=np.int64), flat.reshape(table.num_rows, -1))
    largest = float(np.abs(flat).max(initial=0))
    return pa.Table.from_pydict({"shard": [table.column("shard")[0].as_py()], "dim": [table.column("dim")[0].as_py()], "largest": [largest], "tree": [pickle.dumps(tree, protocol=5)]}, schema=_SHARD)


def _search(queries: np.ndarray, numbers: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    def run(batches):
        least = floor.copy()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] * max(1.0, row["largest"]) * max(1.0, np.abs(queries).max(initial=0)) >= EXACT:
                    raise OverflowError("inner products beyond 2^53 are not exact in doubles; scale the vectors down")
                found = pickle.loads(row["tree"]).search(queries, own, k, least)
                out = [(n, q, i, int(s)) for n, q, best in zip(numbers.tolist(), own.tolist(), found, strict=True) for s, i in best]
                for j, best in enumerate(found):  # the next shard of this task starts from the k-th score
                    if len(best) == k:
                        least[j] = max(least[j], best[-1][0])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_RESULT)

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """The k rows of largest integer inner product for each query row.

    Components become floor(scale * x); a query row is no candidate for itself; ties go to
    the smaller id; fewer than k candidates give fewer rows. Vectors that are null or
    hold null or non-finite components take no part, nor do null ids. Only vectors of the
    same length are compared. Products that doubles can't hold exactly raise OverflowError.
    Repeated ids are candidates each on their own, and each query row has its own k rows.
    Columns of other names are ignored. Returns query_id, rank, vec_id, score.

    Rows are dealt to shards of about ``shard_rows`` by a hash of id and vector; each shard's tree is
    built once and written. Queries go out in blocks of ``block_queries`` (that bounds what is sent);
    each block first searches one shard, and the k-th scores found there are the floor in all others.
    """
    spark = vectors.sparkSession
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = materialise(vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), F.size(vec_col).alias("dim"), is_query.alias("q")), "topk-vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))
    trees = materialise(dealt.groupBy("dim", "shard").applyInArrow(_plant, "shard int, dim int, largest double, tree binary"), "topk-trees")
    asked = rows.where("q").select("id", "v", "dim")
    kinds = asked.groupBy("dim").count().collect()  # one row for each vector length
    path = scratch_path(spark, "topk")
    schema = "query long, query_id long, vec_id long, score long"
    number = 0
    for dim, n in kinds:
        blocks = max(1, -(-n // block_queries))
        for b in range(blocks):
            mine = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "v").toArrow()
            own = np.asarray(mine.column("id"), dtype=np.int64)
            if not len(own):
                continue
            numbers = np.arange(number, number + len(own))
            number += len(own)
            queries = np.asarray(mine.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(own), dim)
            floor = np.full(len(own), -np.inf)
            of_dim = trees.where(F.col("dim") == dim)
            if shards > 1:
                first = of_dim.where(F.col("shard") == 0).mapInArrow(tidied(_search(queries, numbers, own, floor, k)), schema).toArrow()
                got: dict[int, list[int]] = {}
                for q, s in zip(first.column("query").to_pylist(), first.column("score").to_pylist(), strict=True):
                    got.setdefault(q, []).append(s)
                floor = np.array([min(got[q]) if len(got.get(q, ())) == k else -np.inf for q in numbers.tolist()], dtype=np.float64)
            of_dim.repartition(min(shards, 4096)).mapInArrow(tidied(_search(queries, numbers, own, floor, k)), schema).write.mode("append").parquet(path)
    if not kinds:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    out = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
