"""Every query vector against every vector, in cells of bounded size.

Vectors are packed into blocks of bytes. A block of queries and a group of vectors meet in a cell, one task each, where matrix products score them. Query blocks grow
with the queries, so vectors are copied 16 times at most until there are half a million queries. Products in single precision only tell which pairs can be among the best:
what may reach a rank, by a bound on their error, is scored again in double precision, component by component, as ``inner_product`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query blocks asked for, and the least and most queries in one; bytes of the vectors of a group, in double precision, and the least vectors of one.
BLOCKS, LEAST_QUERIES, MOST_QUERIES, GROUP_BYTES, LEAST_GROUP = 16, 256, 32_768, 1 << 26, 1024
#: Vectors packed into one row; queries and vectors of one product; pairs that are scored again at once.
PACKED, ROWS, COLUMNS, AGAIN = 8192, 512, 8192, 1 << 16
#: Vectors with components of this size don't go by products.
LARGE = 1e15
#: Scores are rounded to nine places before they rank: what is no further from the last rank may take it.
NEAR = 1.1e-9


def regular(v: Column, size: Column | int) -> Column:
    """Whether a vector has ``size`` components, all of them finite and not huge."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < LARGE)), F.lit(False))


def measured(rows: DataFrame, v: str) -> tuple[int, int, int, int]:
    """Rows, least and most components, and the rows whose vector is null or has components that are null, not finite or huge."""
    return tuple(rows.agg(F.count(F.lit(1)), F.min(F.size(v)), F.max(F.size(v)), F.count_if(~regular(F.col(v), F.size(v)))).first())


def packed(rows: DataFrame, blocks: int, most: int) -> DataFrame:
    """(block, ids, vectors) from (id, v): up to ``most`` vectors each, dealt in turn; components take four bytes where no digit is lost."""

    def run(batches):
        block = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False)
                single = matrix.astype(np.float32)
                values = [block % blocks], [part.column(0).to_numpy(zero_copy_only=False).tobytes()], [(single if (single == matrix).all() else matrix).tobytes()]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "ids", "vectors"])
                block += 1

    return rows.mapInArrow(run, "block int, ids binary, vectors binary")


def unpacked(blocks: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(x, np.int64) for x, _ in blocks]
    vectors = [np.frombuffer(x, np.float32 if len(x) == 4 * size * len(i) else np.float64).reshape(-1, size) for i, (_, x) in zip(ids, blocks, strict=True)]
    return np.concatenate(ids), np.concatenate(vectors)


def cells(queries: DataFrame, corpus: DataFrame, size: int, n_queries: int, n: int, function: Callable[..., Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What ``function`` yields, as columns, of the query ids, queries, ids and vectors of each cell. Both sides are (id, v), with regular vectors of ``size`` components."""
    of_block, of_group = min(max(-(-n_queries // BLOCKS), LEAST_QUERIES), MOST_QUERIES), max(LEAST_GROUP, GROUP_BYTES // (8 * size))
    blocks, groups = -(-n_queries // of_block), -(-n // of_group)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        met: dict[int, tuple[list, list]] = {}  # one cell, as a partition is one
        for batch in batches:
            cell, side, ids, vectors = batch.columns
            for i in range(batch.num_rows):
                met.setdefault(cell[i].as_py(), ([], []))[side[i].as_py()].append((ids[i].as_buffer(), vectors[i].as_buffer()))
        for asked, found in met.values():
            if asked and found:
                for columns in function(*unpacked(asked, size), *unpacked(found, size)):
                    yield pa.record_batch([pa.array(c) for c in columns], names)

    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = packed(queries, blocks, max(1, of_block // 4)).withColumn("other", every(groups)).select((F.col("block") * groups + F.col("other")).alias("cell"), F.lit(0).alias("side"), "ids", "vectors")
    found = packed(corpus, groups, PACKED).withColumn("other", every(blocks)).select((F.col("other") * groups + F.col("block")).alias("cell"), F.lit(1).alias("side"), "ids", "vectors")
    return asked.unionByName(found).repartitionById(blocks * groups, F.col("cell")).mapInArrow(run, schema)


def own(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place of the query, place of the vector) that share an id, in the order of queries."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids, q_ids, side, sorter=order) for side in ("left", "right"))
    row = np.repeat(np.arange(len(q_ids)), high - low)
    return row, order[np.arange(len(row)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)]


def places(starts: np.ndarray) -> np.ndarray:
    """The place of each element in its run, from 0; ``starts`` is true where a run begins."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def without_copies(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only what can be among the k best of any query: k + 1 different ids, the least, and k rows of each."""
    bits = np.ascontiguousarray(v).view(np.uint32)
    odd = np.random.default_rng(1).integers(1 << 63, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = np.zeros(len(v), np.uint64)
    for j in range(bits.shape[1]):
        hashed += bits[:, j] * odd[j]
    order = np.lexsort((ids, hashed))
    again = np.flatnonzero(hashed[order][1:] == hashed[order][:-1]) + 1
    if len(again) < k:
        return ids, v
    other = np.ones(len(v), bool)  # begins a run of equal vectors
    for start in range(0, len(again), AGAIN):
        at = again[start : start + AGAIN]
        other[at] = (bits[order[at]] != bits[order[at - 1]]).any(axis=1)
    sorted_ids = ids[order]
    new = other | np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]
    which = np.cumsum(new)
    which -= np.maximum.accumulate(np.where(other, which, 0))  # of the different ids of its run, from 0
    kept = order[(which <= k) & (places(new) < k)]
    return ids[kept], v[kept]


def scores(q: np.ndarray, v: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, summed in the order of components."""
    out = np.zeros(len(row))
    for start in range(0, len(row), AGAIN):
        a, b, total = q[row[start : start + AGAIN]].astype(np.float64), v[column[start : start + AGAIN]].astype(np.float64), out[start : start + AGAIN]
        for j in range(q.shape[1]):
            total += a[:, j] * b[:, j]
    return out


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[list[np.ndarray]]:
    """Query id, id and score of the pairs that can be among the k best of a query by rounded score, then id."""
    ids, v = without_copies(ids, v, k)
    single, v_single = q.astype(np.float32), v.astype(np.float32)
    length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    longest = max(length(v[c : c + AGAIN]).max() for c in range(0, len(v), AGAIN))
    error = (q.shape[1] + 3) * 2.0**-23 * length(q) * longest  # twice the bound for sums in single precision
    own_row, own_column = own(q_ids, ids)
    for a in range(0, len(q), ROWS):
        block, slack = single[a : a + ROWS], error[a : a + ROWS]
        n, pairs = len(block), slice(*np.searchsorted(own_row, (a, a + len(block))))
        low = np.full(n, -np.inf)  # what a product must reach
        row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c in range(0, len(v), COLUMNS):
            s = block @ v_single[c : c + COLUMNS].T
            here = (own_column[pairs] >= c) & (own_column[pairs] < c + COLUMNS)
            s[own_row[pairs][here] - a, own_column[pairs][here] - c] = -np.inf
            if not c and s.shape[1] > k:
                low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * slack - NEAR * (1 + 1e-3)
            bar = np.nextafter(np.maximum(low, np.finfo(np.float32).min).astype(np.float32), np.float32(-np.inf))
            r, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
            row, column, score = np.r_[row, r], np.r_[column, j + c], np.r_[score, scores(q, v, r + a, j + c)]
            order = np.lexsort((ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            first = np.r_[True, row[1:] != row[:-1]][: len(row)]
            place, last = places(first), np.full(n, -np.inf)
            last[row[place == k - 1]] = score[place == k - 1]
            last -= NEAR + 1e-15 * np.abs(np.where(np.isfinite(last), last, 0))
            equal = first | np.r_[True, score[1:] != score[:-1]][: len(row)]
            stays = (score >= last[row]) & (places(equal) < k)
            row, column, score = row[stays], column[stays], score[stays]
            low = last - slack
        yield [q_ids[row + a], ids[column], score]


def sums(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Query id, number of vectors with another id, and the sum of their scores, each rounded to nine places."""
    q = q.astype(np.float64)
    own_row, own_column = own(q_ids, ids)
    n, total = len(ids) - np.bincount(own_row, minlength=len(q)), np.zeros(len(q))
    for c in range(0, len(v), COLUMNS):
        part = v[c : c + COLUMNS].astype(np.float64).T
        here = (own_column >= c) & (own_column < c + COLUMNS)
        row, column = own_row[here], own_column[here] - c
        for a in range(0, len(q), ROWS):
            s = q[a : a + ROWS] @ part
            pairs = slice(*np.searchsorted(row, (a, a + len(s))))
            s[row[pairs] - a, column[pairs]] = 0
            total[a : a + len(s)] += np.round(s, 9, out=s).sum(axis=1)
    yield [q_ids[n > 0], n[n > 0], total[n > 0]]
