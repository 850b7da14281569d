"""BM25 within documents: a document's scores against all queries are summed where its text is read, so only the best of each task are shuffled, not a row for each query and document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .every_pair import NEAR, places

#: Contributions, and cells of queries and documents, that are held at once.
PAIRS, CELLS = 1 << 21, 1 << 21


@dataclass
class Asked:
    """What queries ask for: tokens, and the queries of each with the weight of the token in them; token t has entries ``begin[t]`` to ``begin[t + 1]``."""

    ids: np.ndarray
    tokens: list[str]
    begin: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def gathered(rows: list[tuple[int, str, float]]) -> Asked:
    """From (query id, token, weight)."""
    ids, tokens = np.unique(np.array([r[0] for r in rows], np.int64)), sorted({r[1] for r in rows})
    at = {t: i for i, t in enumerate(tokens)}
    token, query = np.array([at[r[1]] for r in rows], np.int64), np.searchsorted(ids, [r[0] for r in rows])
    order = np.lexsort((query, token))
    return Asked(ids, tokens, np.searchsorted(token[order], np.arange(len(tokens) + 1)), query[order], np.array([r[2] for r in rows], np.float64)[order])


def counted(batch: pa.RecordBatch, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (id, tokens): the tokens asked for in each document, as (document, token, times), in order, and the lengths of all documents."""
    listed = batch.column(1)
    length = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    token = pc.fill_null(pc.index_in(listed.flatten(), value_set=tokens), -1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(length)), length)
    key, times = np.unique(doc[token >= 0] * len(tokens) + token[token >= 0], return_counts=True)
    return key // len(tokens), key % len(tokens), times, length


def best(docs: DataFrame, asked: Asked, k: int, mean_length: float, k1: float, b: float) -> DataFrame:
    """(qid, item, score) of documents (id, tokens) that share a token with a query: at least the k best of each task by score rounded to nine places, then id. Ids are whole numbers and
    no two alike."""

    def run(batches):
        tokens, many = pa.array(asked.tokens, pa.string()), len(asked.ids)
        query, item, score, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(many, -np.inf)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, token, times, length = counted(batch, tokens)
            entries = asked.begin[token + 1] - asked.begin[token]
            cost = np.bincount(doc, weights=entries, minlength=len(ids)).astype(np.int64)
            total, start = np.r_[0, np.cumsum(cost)], 0
            while start < len(ids):
                end = max(start + 1, min(start + max(1, CELLS // many), int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1))
                part = slice(*np.searchsorted(doc, (start, end)))
                e, n = entries[part], int(total[end] - total[start])
                which = np.arange(n) + np.repeat(asked.begin[token[part]] - np.cumsum(e) + e, e)
                tf = times[part].astype(np.float64)
                share = asked.weight[which] * np.repeat(tf, e) * (k1 + 1) / np.repeat(tf + k1 * (1 - b + b * length[doc[part]] / mean_length), e)
                cell = asked.query[which] * (end - start) + np.repeat(doc[part] - start, e)
                s = np.bincount(cell, weights=share, minlength=many * (end - start))  # in the order of tokens
                met = np.zeros(len(s), bool)
                met[cell] = True
                s = np.where(met, s, -np.inf).reshape(many, end - start)
                bar = low
                if end - start > k:  # the k-th best of the block bounds it too
                    bar = np.maximum(low, np.partition(s, end - start - k, axis=1)[:, end - start - k] - NEAR * (1 + 1e-3))
                r, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
                query, item, score = np.r_[query, r], np.r_[item, ids[start + j]], np.r_[score, s[r, j]]
                order = np.lexsort((item, -score, query))
                query, item, score = query[order], item[order], score[order]
                first = np.r_[True, query[1:] != query[:-1]][: len(query)]
                at = places(first) == k - 1
                low[query[at]] = score[at] - NEAR - 1e-15 * np.abs(score[at])
                equal = first | np.r_[True, score[1:] != score[:-1]][: len(query)]
                stays = (score >= low[query]) & (places(equal) < k)
                query, item, score = query[stays], item[stays], score[stays]
                start = end
        yield pa.record_batch([pa.array(asked.ids[query]), pa.array(item), pa.array(score)], ["qid", "item", "score"])

    return docs.mapInArrow(run, "qid long, item long, score double")
