"""Exact top-k inner-product search by the threshold algorithm.

Candidates are dealt into blocks, queries into blocks, and each pair of blocks is a cell. A cell
sorts every dimension of its candidates into a list. A query reads the lists from their large end
where its component is positive and from their small end where it is negative, in rounds of
growing depth; rows that it has met are scored in full. The bound on all others is the inner
product of the query with the values at the present depth: once it is below the kth score the
query stops. The best of all cells are merged.

Scores are exact while they stay below 2**53. Vectors of different lengths do not meet. A row is
not its own candidate (same id). Ties go to the smaller id.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no
part; a query with fewer than k candidates gets all; rows with the same id are each candidates of
other queries, and as query rows are queries of their own with k results each; rows without an id take no part (neither could be named in the result); an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cells import grouped
from lodestone.llm.common import map_arrow

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8192, 4096
#: Depth of the first round; each round goes so many times deeper.
DEPTH, DEEPER = 64, 4


def integers(column: str, scale: float) -> F.Column:
    """floor(scale * x) of each component, the component as a double."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)))


def finite(column: str) -> F.Column:
    c = F.col(column).cast("array<double>")
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def threshold_search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, batch: int = 512):
    """For each query (index into queries) the indexes into x of its k best rows, and their scores.

    ids must be ascending: of equal scores the smaller index is better."""
    n = len(x)
    order = np.argsort(-x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], 0)  # a row's place in each list
    high = np.take_along_axis(x, order, 0)
    low = high[::-1]
    out_q, out_c, out_s = [], [], []
    for lo in range(0, len(queries), batch):
        q, own = queries[lo : lo + batch], query_ids[lo : lo + batch]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        up_mask, down_mask = (q > 0).astype(np.float32), (q < 0).astype(np.float32)
        score = np.full((len(q), n), -np.inf)
        known = np.zeros(n, bool)  # rows whose scores are computed
        live = np.arange(len(q))
        met = np.zeros((len(q), n), bool)
        depth = DEPTH
        while len(live):
            depth = min(depth, n)
            seen = up_mask[live] @ (place < depth).T.astype(np.float32)
            seen += down_mask[live] @ (place >= n - depth).T.astype(np.float32)
            met[live] = (seen > 0) | (depth == n)
            new = met[live].any(0) & ~known
            if new.any():
                score[:, new] = q @ x[new].T
                known |= new
            now = np.where(met[live], score[live], -np.inf)
            now[own[live][:, None] == ids[None, :]] = -np.inf
            bound = up[live] @ high[depth - 1] + down[live] @ low[depth - 1]
            kth = np.partition(now, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
            done = (bound < kth) | (depth == n)
            if done.any():
                rows = now[done]
                m = min(k, n)
                least = np.partition(rows, n - m, axis=1)[:, n - m, None]
                above, tied = rows > least, rows == least
                # of the rows with the mth score those of the least indexes
                tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= m - above.sum(1, keepdims=True)
                a, b = np.nonzero((above | tied) & np.isfinite(rows))
                out_q.append(live[done][a] + lo)
                out_c.append(b)
                out_s.append(rows[a, b].astype(np.int64))
            live = live[~done]
            depth *= DEEPER
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_c), join(out_s)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Both tables hold an id and an array of integers without nulls."""
    pick = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<long>").alias("vector"))
    rows, asked = (pick(df).where("id IS NOT NULL") for df in (candidates, queries))
    asked = asked.withColumn("query", F.monotonically_increasing_id())  # a repeated id is a query of its own
    blocks, q_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, candidate_block), (asked, query_block)))
    deal = lambda own, n, other, m: (F.pmod(F.xxhash64("id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))
    columns = ("dim", "c", "q", "asks", "id", "vector", "query")
    left = rows.select("id", "vector", F.size("vector").cast("long").alias("dim"), *deal("c", blocks, "q", q_blocks)).withColumn("asks", F.lit(False)).withColumn("query", F.lit(None).cast("long")).select(*columns)
    right = asked.select("id", "vector", "query", F.size("vector").cast("long").alias("dim"), *deal("q", q_blocks, "c", blocks)).withColumn("asks", F.lit(True)).select(*columns)
    dealt = left.union(right).repartition("dim", "c", "q").sortWithinPartitions("dim", "c", "q", "asks", "id")

    def run(batches):
        for cell in grouped(batches, 3):
            asks = cell.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            ids = cell.column("id").to_numpy()
            dim = cell.column("dim")[0].as_py()
            x = cell.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim).astype(float)
            q, c, s = threshold_search(x[~asks], ids[~asks], x[asks], ids[asks], k)
            if len(q):
                which = cell.column("query").to_numpy()[asks].astype(np.int64)
                yield {"query": which[q], "query_id": ids[asks][q], "vec_id": ids[~asks][c], "score": s}

    found = map_arrow(dealt, run, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
