"""Near-duplicates by SimHash: pigeonhole blocks, verified Hamming distance, components.

A fingerprint's 64 bits are cut into ``blocks`` parts. Fingerprints that differ in at most
``radius`` bits agree in at least ``blocks - radius`` parts, so for each choice of that many parts
they are grouped by the bits there. A group's links are found in numpy by search from one fingerprint to those not
yet reached, so that a group of n close fingerprints gives n - 1 links, not all pairs. A group
beyond ``GROUP`` fingerprints is cut into chunks, and each two chunks meet in a task of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, keyed, map_arrow, pick, prepare, salted
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one group that one task compares at once.
GROUP = 4096


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one UTF-8 text; 0 if it has no words."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = stop[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id, tag, doc_id and fp (the fingerprint as a signed long) of each row of ``keyed`` documents."""

    def run(batch: pa.RecordBatch):
        found = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column(3))], np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(found.view(np.int64))], ["id", "tag", "doc_id", "fp"])

    return map_arrow(rows, run, "id long, tag long, doc_id long, fp long")


def blocks_for(n: int, radius: int) -> int:
    """Parts to cut into: the fewest for which a group holds few of n fingerprints that are close by chance only."""
    for blocks in range(radius + 2, radius + 5):
        if (1 << (64 * (blocks - radius) // blocks)) >= n:
            return blocks
    return radius + 4


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links among distinct fingerprints: each is compared only with those not yet reached."""
    out = []
    rest = fps.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _small_links(keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, most: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links inside groups of at most ``most``: each fingerprint against those up to most - 1 places on."""
    a, b = [], []
    for step in range(1, most):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & (sizes[step:] <= most))
        if not len(same):
            break
        near = same[np.bitwise_count((fps[same] ^ fps[same + step]).view(np.uint64)) <= radius]
        a.append(fps[near])
        b.append(fps[near + step])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(x, y): links between the fingerprints of ``distinct`` (fp: long, n of them, no two the same) that connect all that
    differ in at most ``radius`` bits."""
    blocks = blocks_for(n, radius)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(part[k] for k in choice) for choice in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    by_mask = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "bits")
    rows = distinct.select("fp", by_mask).select(F.xxhash64("mask", "bits").alias("key"), "fp")
    large = rows.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    rows = rows.join(large, "key", "left").withColumn("chunk", F.coalesce(own, F.lit(0)))
    # a row of chunk c of k meets the chunks 0..k-1, under the number of the pair
    pair = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda o: F.least(o, F.col("chunk")) * 1_000_003 + F.greatest(o, F.col("chunk")))
    rows = rows.select("fp", "key", F.explode(pair).alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "fp")
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(keys, fps):
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            length = np.diff(np.append(first, len(keys)))
            a, b = _small_links(keys, fps, np.repeat(length, length), 16, radius)
            for at, size in zip(first[length > 16].tolist(), length[length > 16].tolist(), strict=True):
                if more := _links(np.unique(fps[at : at + size]), radius):
                    both = np.array(more, np.uint64).view(np.int64)
                    a, b = np.concatenate((a, both[:, 0])), np.concatenate((b, both[:, 1]))
            keep = a != b
            return pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["x", "y"])

        for batch in batches:
            keys = np.concatenate((held_keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(keys):
                continue
            at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if at:
                yield found(keys[:at], fps[:at])
            held_keys, held = keys[at:], fps[at:]
        if len(held):
            yield found(held_keys, held)

    return sorted_.mapInArrow(run, "x long, y long").distinct()


def _owners(rows: DataFrame, radius: int) -> DataFrame:
    """fp, root (the least fingerprint that links reach) and component (the least id there) of each fingerprint of ``rows``."""
    # one node per fingerprint: its least document
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found = links(nodes.select("fp"), nodes.count(), radius)
    # components run on fingerprints; the least document follows by an aggregate
    roots = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = labelled.groupBy("root").agg(F.min("least").alias("component"))
    return labelled.join(heads, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and tag of every row. component_id is the smallest doc_id that links
    reach, itself included. Null texts and texts without words have fingerprint zero, which links like any other. Rows with a null doc_id
    are linked too, and count as larger than any; a component of such rows alone has a null component_id. Repeated rows
    each give their row, an empty table none."""
    prepare(docs.sparkSession)
    rows = cut(fingerprints(keyed(docs), shingle))
    owner = _owners(rows, radius).select("fp", "component")
    null = F.lit(None).cast("long")
    # very many rows may have one fingerprint: exact copies, texts without words
    return salted(rows, owner, ["fp"], hot_keys(rows, ["fp"])).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component") == (1 << 63) - 1, null).otherwise(F.col("component")).alias("component_id"),
        "tag",
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one each, of the smallest doc_id. A component of rows without a doc_id keeps one of them,
    and rows that repeat a doc_id stand for as many components as they form. Texts without words are one component. Columns as they are."""
    prepare(docs.sparkSession)
    rows = cut(fingerprints(keyed(docs), shingle))
    first = rows.groupBy("fp").agg(F.min(F.struct("id", "tag")).alias("one")).select("fp", "one.*")
    chosen = first.join(_owners(rows, radius), "fp").groupBy("root").agg(F.min(F.struct("id", "tag")).alias("one")).select("one.*")
    return pick(docs, chosen)
