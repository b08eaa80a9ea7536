"""Exact top-k by inner product: a KD-tree per shard, searched best box first with a propagated kth score.

Components are floor(64 x) of the double x. Rows are dealt to shards and queries to blocks by a hash of their ids, both
of bounded size; a task searches one shard's tree for one block. Trees split at the median of the widest dimension and
keep tight boxes. A box's bound for query q is the sum of max(q lo, q hi) over the dimensions; boxes are visited from
the highest bound, until it lies below the kth score found, or equals it and the box has no smaller id than the kth.
First each block searches one shard; the kth score found there is where its searches of all other shards begin.

Rows with components of 2^27 or more in magnitude are searched apart from the others, in Python integers where 64 bits are
too few. As in the SQL, a component that does not fit into 64 bits is an error, and so is a score among the best k of
2^63 - 1 or more in magnitude.

Null vectors, vectors with null or non-finite components, and rows without an id take no part. Vectors meet only vectors of their own length. Ties go to the smaller id. Rows that repeat an id are
candidates each, but never of a query of that id; a query id that repeats asks once, with its smallest vector.
An empty table gives no rows. A vector of any length is one row, and a box holds two of them. Other columns are not read, so
none can clash.

The work is queries times shards: a query's block asks every shard, and in many dimensions boxes rule few shards out. So the
shuffle holds each shard once for each block of ``BLOCK_QUERIES`` queries, and grows with the square of the table where a fixed
share of it asks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.llm.common import Scratch, table

K = 20
#: Rows of a shard and queries of a block, about; they bound a task's memory.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 2048, 128
#: Components from here on are wide: their rows and queries are searched on their own, so that they slow no others.
WIDE = 1 << 27
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class KDTree:
    """Arrays over nodes: box, smallest id, row range, children (0: leaf). Rows are permuted so that ranges are slices."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, least, span, kids = [], [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = vectors[order[a:b]]
            node = len(low)
            if parent >= 0:
                kids[parent][side] = node
            low.append(part.min(0))
            high.append(part.max(0))
            least.append(ids[order[a:b]].min())
            span.append((a, b))
            kids.append([0, 0])
            if b - a > leaf and part.shape[1]:
                wide = int(np.argmax((high[-1] - low[-1]).astype(np.float64)))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide].astype(np.float64), mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.least, self.span, self.kids = [int(x) for x in least], span, kids

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floors: list[int], k: int = K) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) of this shard that reach its floor, without rows of its own id."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        rows = self.vectors.T.copy()
        return [self._one(queries[i], int(query_ids[i]), floors[i], bounds[i], rows, k) for i in range(len(queries))]

    def _one(self, q, own: int, floor: int, bound, rows, k: int) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst kept first
        kth, kth_id = floor, None
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth or (kth_id is not None and -top == kth and self.least[node] > kth_id):
                if -top < kth:
                    break
                continue
            left, right = self.kids[node]
            if left:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            scores = q @ rows[:, a:b]
            for j in np.flatnonzero(scores >= kth):
                rid = int(self.ids[a + j])
                if rid == own:
                    continue
                item = (int(scores[j]), -rid)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                else:
                    continue
                if len(best) == k and best[0][0] >= kth:
                    kth, kth_id = best[0][0], -best[0][1]
        return [(s, -i) for s, i in best]


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(t.num_rows, -1 if t.num_rows and len(flat) else 0)


def _most(x: np.ndarray) -> np.ndarray:
    """The greatest magnitude of each row, as a double: int64 has none for its least number."""
    return np.abs(x.astype(np.float64)).max(1, initial=0)


def _exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the fastest type that keeps all scores and bounds exact."""
    most = float(_most(x).max()) * float(_most(q).max()) * max(1, x.shape[1])
    # Sums below 2^53 are exact in doubles, which multiply far faster.
    kind = np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object
    return x.astype(kind), q.astype(kind)


def _search_pair(rows: pa.Table, asked: pa.Table) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not rows.num_rows or not asked.num_rows:
        return schema.empty_table()
    x, q = _matrix(rows), _matrix(asked)
    ids, query_ids = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy()
    floors = asked["floor"].fill_null(LEAST).to_numpy()
    wide_x, wide_q, flat = _most(x) >= WIDE, _most(q) >= WIDE, []
    for r in (~wide_x, wide_x):
        for a in (~wide_q, wide_q):
            if r.any() and a.any():
                some, of = _exact(x[r], q[a])
                found = KDTree(some, ids[r]).search(of, query_ids[a], floors[a].tolist())
                flat += [(int(i), v, min(max(s, LEAST), MOST)) for i, hits in zip(query_ids[a], found, strict=True) for s, v in hits]
    return pa.Table.from_arrays([pa.array([f[c] for f in flat], pa.int64()) for c in range(3)], schema=schema)


def _search(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """Each shard is sent to the blocks that ask it; a (shard, block) pair is one task's work."""
    pairs = asked.select(F.col("shard").alias("to_shard"), F.col("dim").alias("to_dim"), F.col("block").alias("to_block")).distinct()
    rows = shards.join(pairs, (shards["shard"] == pairs["to_shard"]) & (shards["dim"] == pairs["to_dim"])).select("to_shard", "to_dim", "to_block", "vec_id", "v")
    return rows.groupBy("to_shard", "to_dim", "to_block").cogroup(asked.groupBy("shard", "dim", "block")).applyInArrow(_search_pair, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all other rows."""
    scratch = Scratch(df.sparkSession, "topk")
    sound = F.forall(F.col("w"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("w"), is_query.alias("is_query")).filter(sound)
    fits = lambda x: (x * 64 >= -(2.0**63)) & (x * 64 < 2.0**63)
    floored = F.transform("w", lambda x: F.when(fits(x), F.floor(x * 64).cast("long")).otherwise(F.raise_error(F.lit("top_k: a component does not fit into 64 bits")).cast("long")))
    rows = scratch.save(rows.select("vec_id", floored.alias("v"), "is_query").withColumn("dim", F.size("v")))
    n, asked_n = rows.agg(F.count("*"), F.sum(F.col("is_query").cast("long"))).first()
    n_shards, n_blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-(asked_n or 0) // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_shards)).cast("int")
    shards = rows.select("vec_id", "v", "dim", shard.alias("shard"))
    asked = rows.filter("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    block = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(n_blocks)).cast("int")
    asked = scratch.save(asked.withColumn("block", block))
    home = F.pmod(F.col("block"), F.lit(n_shards)).cast("int")
    first = scratch.save(_search(shards, asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long"))))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != home)
    rest = asked.join(floors, "query_id", "left").withColumn("shard", F.explode(others))
    hits = first.unionByName(_search(shards, rest)) if n_shards > 1 else first
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("score").isin(LEAST, MOST), F.raise_error(F.lit("top_k: a score does not fit into 64 bits")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
