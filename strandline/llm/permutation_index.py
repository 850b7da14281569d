"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. A shard of the index has an inverted file for each pivot: which of its vectors are posted
there, and at which place of their order. A vector is posted under its ``PREFIX`` nearest pivots of ``PIVOTS`` only, and a query reads the files of its own
nearest pivots only, an eighth of them. From these follows the footrule distance of the two orders, each cut at the prefix: it is least where
the sum of ``PREFIX - max(place, place)`` over the shared pivots is largest. The share of the shard that is least far is ranked again by exact inner products.

Nearness is the inner product, which depends on a vector's length as well. So, for the order of pivots, indexed vectors get one component more,
which brings all to the length of the longest; queries get a zero there. Inner products stay as they are, and nearness among vectors of one length is one of angles.

Queries and shards meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, prepare

#: Pivots, taken among the vectors with the least hash of their id: the documented sample that fits the index.
PIVOTS = 512
#: How many of its nearest pivots a vector is posted under, and a query reads.
PREFIX = 64
#: Ranked again exactly: this share of a shard, and so many times the neighbours asked for.
SHARE, MORE = 0.12, 8
SHARD, QUERY_BLOCK, NEIGHBOURS = 8192, 2048, 20


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array<double>): vectors that are not null nor zero, and have finite components only."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def level(matrix: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that brings them to length ``longest``."""
    return np.hstack((matrix, np.sqrt(np.maximum(0.0, longest**2 - (matrix * matrix).sum(axis=1)))[:, None]))


def choose_pivots(rows: DataFrame, n: int, longest: float) -> np.ndarray:
    """Up to n different vectors with the least hash of their id, levelled."""
    some = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(4 * n).collect()
    seen = dict.fromkeys(tuple(r.v) for r in some)
    return level(np.array(list(seen)[:n]), longest)


def nearest(matrix: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each (levelled) vector its nearest pivots, nearest first, ties to the earlier pivot."""
    return np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def post(orders: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files of some orders: where the file of each pivot begins, the vectors in it, and their places."""
    by_pivot = np.argsort(orders.ravel(), kind="stable")
    begin = np.searchsorted(orders.ravel()[by_pivot], np.arange(n_pivots + 1)).astype(np.int32)
    return begin, (by_pivot // orders.shape[1]).astype(np.int32), (by_pivot % orders.shape[1]).astype(np.int32)


def closeness(order: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For one query's order, how near each of n posted vectors is by the footrule of prefixes: larger is nearer, 0 shares no pivot."""
    begin, members, places = files
    prefix = len(order)
    size = begin[order + 1] - begin[order]
    at = np.repeat(begin[order] - np.cumsum(size) + size, size) + np.arange(size.sum())
    gain = prefix - np.maximum(places[at], np.repeat(np.arange(prefix), size))
    return np.bincount(members[at], weights=gain, minlength=n)


def _blocks(rows: DataFrame, n_blocks: int, name: str, pivots: np.ndarray, prefix: int, longest: float | None) -> DataFrame:
    """One row per block: its vectors' ids, in order, the vectors, and their orders of pivots, posted (``longest`` is given) or plain."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        matrix = np.stack(frame["v"].to_numpy())
        levelled = np.hstack((matrix, np.zeros((len(matrix), 1)))) if longest is None else level(matrix, longest)
        orders = nearest(levelled, pivots, prefix)
        files = [orders] if longest is None else post(orders, len(pivots))
        return pd.DataFrame({name: [frame["block"].iloc[0]], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "vectors": [np.ascontiguousarray(matrix).tobytes()], "files": [[np.ascontiguousarray(f).tobytes() for f in files]]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, f"{name} int, ids binary, vectors binary, files array<binary>")


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, share: float = SHARE, n_pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates found with the largest inner product, ties to the smaller id, for each row of ``queries``
    (of the same columns) against every row of ``vectors`` but those with the query's own id. Vectors that are null, zero or not finite
    take no part; nor do rows with a null id. Vectors of different lengths raise ValueError. Rows that repeat an id are candidates each; of queries that
    repeat one, the smallest vector counts. Without candidates there are no rows; other columns take no part."""
    spark = vectors.sparkSession
    prepare(spark)
    base = valid(vectors, id_col, vector_col).where("id is not null")
    asked = valid(queries, id_col, vector_col).where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest, low, high = base.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.min(F.size("v")), F.max(F.size("v"))).first()
    n_asked, q_low, q_high = asked.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len({low, high, q_low, q_high}) > 1:
        raise ValueError(f"vectors have different lengths, {min(low, q_low)} to {max(high, q_high)}")
    pivots = choose_pivots(base, n_pivots, longest)
    prefix = min(prefix, len(pivots))
    n_shards, n_blocks = -(-n // SHARD), -(-n_asked // QUERY_BLOCK)
    shards = _blocks(base, n_shards, "shard", pivots, prefix, longest)
    blocks = _blocks(asked, n_blocks, "q_block", pivots, prefix, None).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("files")[0].alias("q_orders"))
    meet = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).join(shards, "shard").select("ids", "vectors", "files", "q_ids", "q_vectors", "q_orders")

    def find(batch: pa.RecordBatch):
        for j in range(batch.num_rows):
            row = batch.slice(j, 1).to_pylist()[0]
            ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            matrix = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
            asked_ = np.frombuffer(row["q_vectors"], np.float64).reshape(len(q_ids), -1)
            orders = np.frombuffer(row["q_orders"], np.int32).reshape(len(q_ids), -1)
            files = tuple(np.frombuffer(f, np.int32) for f in row["files"])
            take = min(len(ids), int(np.ceil(share * len(ids))) + MORE * k)
            out: list[list] = [[], [], []]
            tie = np.arange(len(ids), 0, -1) / (len(ids) + 1)  # among equals, smaller ids
            for order, q, v in zip(orders, q_ids, asked_, strict=True):
                near = closeness(order, files, len(ids)) + tie
                near = np.argpartition(-near, take - 1)[:take]
                near = near[ids[near] != q]
                score = (matrix[near] * v).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                out[0].append(np.full(len(best), q))
                out[1].append(ids[near][best])
                out[2].append(score[best])
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    found = map_arrow(meet.repartition(n_shards * n_blocks), find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
