"""Connected components of links between longs, by alternating large-star and small-star rounds.

Each round joins links with the least neighbour of each end, which is aggregated before the
shuffle, so that a node with very many links makes one row per task; its links are dealt over many tasks for the
join. A round's links go to the checkpoint folder; the driver sees two numbers a round.
Up to ``FEW`` links need no rounds: one task settles them in numpy. A round is a dozen plans, broadcasts and jobs, whose traces the driver holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, LEAST_HOT, cut, salted

MAX_ROUNDS = 60
#: Links that one task settles by itself: 8 MB of them.
FEW = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as these: from the least node of each to its others."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _sign(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def _met(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``links``, n at most, each with m of its a in ``least`` (a, m, n: a's links)."""
    hot = F.broadcast(least.where(F.col("n") > max(LEAST_HOT, n // HOT_SHARE)).select("a", F.lit(True).alias("hot")))
    return salted(links, least.drop("n"), ["a"], hot)


def _settled(batches):
    """(a, b) of all links of a task as (node, root)."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)]
    root, node = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
    for k in range(0, len(node), 50_000):
        yield pa.record_batch([pa.array(c[k : k + 50_000]) for c in (node, root)], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long) but the roots: root is the least node it can reach. Loops and
    repeated links don't matter; without links there are no rows."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())  # a > b
    sign = _sign(links)
    if sign[0] <= FEW:
        return cut(links.coalesce(1).mapInArrow(_settled, "node long, root long"))
    for _ in range(MAX_ROUNDS):
        if not sign[0]:
            break
        # large-star: each larger neighbour of a node gets the node's least neighbour, itself included
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _met(both.where("b > a"), least, sign[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small-star: each smaller neighbour of a node, and the node, get the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _met(large, least, sign[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _sign(links)
        if after == sign:
            break
        sign = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
