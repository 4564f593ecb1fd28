"""Exact top-k by inner product without random access: sorted lists are read in step, with bounds on every score.

There is one list for each component, sorted by value, and read from its top for a positive query component and from
its bottom for a negative one. After d entries of each list, a candidate's score lies between bounds: its unseen
components are at most what the lists have reached and at least what they end with. Reading stops when at most a few
candidates' upper bounds reach the k-th best lower bound; these are resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import new_path, written

#: Candidates of a block and queries of a lot: a task holds a few matrices of one by the other.
CANDIDATES, QUERIES = 8192, 256
#: Parts of the lists that are read before bounds are looked at.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 1.0)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component, without rows whose vector is null or has null or non-finite ones."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


class Block:
    """Candidates with their components' lists, sorted once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        ordered = np.argsort(ids, kind="stable")  # rows by id, so that a stable sort settles ties
        self.ids, self.whole = ids[ordered], x[ordered]
        self.x = self.whole.astype(np.float64)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.x, order, axis=0)
        self.place = np.empty(order.shape, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.read = 0

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best among these candidates, other than itself; ties to smaller ids.

        `known`: a score that each query's k-th best is sure to reach; what can't reach it is no candidate. Rows that
        are outsiders for all queries of the lot are dropped after each reading, and so are queries that are settled.
        """
        n, out = len(self.ids), []
        active, rows = np.arange(len(query_ids)), np.arange(n)
        known = np.full(len(query_ids), -np.inf) if known is None else known.astype(np.float64)
        done_depth = 0
        for part in DEPTHS:
            depth = min(n, max(1, 4 * k, int(n * part)))
            if depth == done_depth or not len(active) or not len(rows):
                continue
            self.read += (depth - done_depth) * self.x.shape[1] * len(active)
            done_depth = depth
            weights = q[active].astype(np.float64)
            signs = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1).T
            x, place = self.x[rows], self.place[rows]
            top, bottom = place >= n - depth, place < depth
            upper = np.concatenate([np.where(top, x, self.lists[n - depth]), np.where(bottom, x, self.lists[depth - 1])], axis=1) @ signs
            lower = np.concatenate([np.where(top, x, self.lists[0]), np.where(bottom, x, self.lists[-1])], axis=1) @ signs
            own = self.ids[rows][:, None] == query_ids[active]
            upper[own] = lower[own] = -np.inf
            if len(rows) > k:
                known[active] = np.maximum(known[active], np.partition(lower, len(rows) - k, axis=0)[len(rows) - k])
            slack = 1e-9 * (np.abs(weights) @ np.abs(self.lists[[0, -1]]).max(axis=0))
            may = (upper >= known[active] - slack) & ~own
            done = (may.sum(axis=0) <= 4 * k) | (depth == n)
            at, cols = np.nonzero(may[:, done])
            who, at = active[np.flatnonzero(done)[cols]], rows[at]
            score = np.einsum("ij,ij->i", self.whole[at], q[who])
            best = np.lexsort((at, -score, who))
            rank = np.arange(len(best)) - np.searchsorted(who[best], who[best])
            best = best[rank < k]
            out.append((query_ids[who[best]], self.ids[at[best]], score[best]))
            active, rows = active[~done], rows[may[:, ~done].any(axis=1)]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best among these candidates, other than itself; ties to smaller ids."""
    return Block(ids, x).search(query_ids, q, k)


def _lots(folder: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and known scores of the queries, a lot at a time, from where they were written."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(folder)
    for batch in ds.dataset(root, filesystem=store, format="parquet").to_batches(columns=["id", "v", "known"], batch_size=QUERIES):
        if len(batch):
            yield batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]), width), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)


def _search(vectors: DataFrame, folder: str, width: int, k: int) -> DataFrame:
    def run(a: pa.Table) -> pa.Table:
        block, found = Block(a["id"].to_numpy(), _matrix(a["v"], width)), []
        for ids, q, known in _lots(folder, width):
            found.append(block.search(ids, q, k, known))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return vectors.groupBy("block").applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best. Both tables: (id long, v array<long>).

    Candidates are dealt into blocks by a hash of their ids, once; queries are written once, and every task streams them
    in lots past the lists of its block. The first block gives each query a score that its k-th best is sure to reach,
    with which all other blocks stop early. What comes back is at most k rows for each query and block. The search is
    exact, so its work grows with queries times candidates; memory and what is moved don't. Repeated ids are candidates
    each on their own, but a query never meets its own id. No queries or no candidates: no rows.
    """
    n, width = vectors.count(), max((r[0] or 0) for r in (vectors.agg(F.max(F.size("v"))).first(), queries.agg(F.max(F.size("v"))).first()))
    blocks = max(1, -(-n // CANDIDATES))
    dealt = vectors.select(F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    spark = vectors.sparkSession

    def asked(df: DataFrame) -> str:
        df.write.parquet(path := new_path(spark, "queries"))
        return path

    first = written(_search(dealt.where("block = 0"), asked(queries.select("id", "v", F.lit(float("-inf")).alias("known"))), width, k), "first")
    near = first
    if blocks > 1:
        sure = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s")).where(F.col("n") >= k).select("query_id", "s")
        told = queries.select("id", "v").join(sure, queries.id == sure.query_id, "left").select("id", "v", F.coalesce("s", F.lit(float("-inf"))).alias("known"))
        near = first.unionByName(_search(dealt.where("block > 0"), asked(told), width, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
