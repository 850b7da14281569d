"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix is a place in a text. Suffixes that begin alike form a bucket, and each holds the pointer of its bucket: the least address of
its members. First come buckets of equal q-grams; then, round by round, the members of a bucket are sorted by the
pointers of the suffixes ``h`` bytes on, and so split into buckets that agree in ``2 h`` bytes, up to the full length. A suffix that is alone is
done, and leaves the table: in the next round the suffixes before it find no pointer there, and are done as well, without being sorted. So
each round reuses what the former ones have settled.

Two filters come before, so that only suffixes that may repeat are refined:

1. runs of windows with one anchor, in buckets by the anchor's q-gram (``core``), and inside them by all bytes they cover (``hull``): a core met once
   rules its windows out, a core with one hull settles them;
2. the same for blocks of at most ``BLOCK`` windows inside the runs left open.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, attach, keyed, map_arrow, prepare, store, unsqueeze
from .rolling import Levels, mix
from .spans import chunks, inside, merged, pieces, runs, unpack, with_spans

LENGTH, GRAM, BLOCK = 400, 145, 16
UNITS = "id long, tag long, first int, last int, core long, hull long, weight long"


def refine(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, open): units whose windows all occur elsewhere, and one unit per core and hull for which that is open.
    ``units`` has the columns of UNITS; weight counts the places a unit stands for."""
    buckets = units.groupBy("core").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("size"), F.min("hull").alias("low"), F.max("hull").alias("high")).where("n > 1")
    active = store(attach(units, buckets, ["core"], "size").drop("n", "size"), "active")
    settled = active.where("low = high")
    mixed = active.where("low <> high")
    one = F.min(F.struct("id", "tag", "first", "last")).alias("one")
    by_hull = mixed.groupBy("core", "hull").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("size"), one)
    twice = attach(mixed, by_hull.where("all > 1").select("core", "hull", "size"), ["core", "hull"], "size")
    columns = ["id", "tag", "first", "last"]
    open_ = by_hull.select("one.*", F.col("all").alias("weight"))
    return settled.select(*columns).union(twice.select(*columns)), open_


def _blocks(parts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """The units inside each part: blocks of windows by their place before the anchor."""

    def run(batch: pa.RecordBatch):
        ids, tags, firsts, lasts, weights = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
        texts = as_bytes(batch.column(5))
        for a, b in chunks(texts):
            raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            start = np.cumsum(sizes) - sizes
            levels = Levels(raw)
            # all windows of a part have its anchor: the leftmost least gram of its first window
            grams = levels.all(gram)
            key = np.append((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
            edges = np.stack((start, start + length - gram + 1), axis=1).ravel()
            anchor = (np.minimum.reduceat(key, edges)[::2] & np.uint64(0xFFFFFFFF)).astype(np.int64) - start
            part, window = inside(lasts[a:b] - firsts[a:b] + 1)
            place = (anchor[part] - window) // block
            low = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (part[1:] != part[:-1]))))
            high = window[np.append(low[1:], len(part)) - 1]
            part, place, low = part[low], place[low], window[low]
            # what every window of a whole block shares, whether or not this part has them all
            begin = anchor[part] - place * block + start[part]
            core = mix(levels.spans(begin, begin - block + 1 + length) + place.astype(np.uint64))
            hull = Levels(raw, 1).spans(low + start[part], high + start[part] + length)
            columns = (ids[a:b][part], tags[a:b][part], low + firsts[a:b][part], high + firsts[a:b][part], core.view(np.int64), hull.view(np.int64), weights[a:b][part])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in UNITS.split(", ")])

    return map_arrow(parts, run, UNITS)


def steps(length: int, rounds: int = 2) -> tuple[int, list[int]]:
    """q, and for each round the offset of the later suffix: prefixes grow from q to ``length``, the last step overlapping where it must."""
    q = -(-length // (1 << rounds))
    out, have = [], q
    while have < length:
        out.append(min(have, length - have))
        have += out[-1]
    return q, out


def offsets(later: list[int]) -> list[int]:
    """How far behind a window a suffix may stand that these steps ask for."""
    out = {0}
    for step in later:
        out |= {o + step for o in out}
    return sorted(out)


def addressed(parts: DataFrame) -> DataFrame:
    """``parts`` with the address of their first byte: every byte of every part has one of its own. Written, so that it stays."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            size = np.array([len(x) + 1 for x in batch.column("part").to_pylist()], np.int64)
            base = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.record_batch([*batch.columns, pa.array(base, pa.int64())], [*batch.schema.names, "base"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return store(parts.mapInArrow(run, f"{schema}, base long"), "addressed")


def suffixes(parts: DataFrame, length: int) -> DataFrame:
    """(at, ahead, gram): the address and the q-gram of every suffix that refinement asks for; bit j of ahead says that it stands the j-th of
    ``offsets`` behind a window of its part."""
    q, later = steps(length)
    behind = offsets(later)

    def run(batch: pa.RecordBatch):
        first, last, base = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last", "base"))
        texts = as_bytes(batch.column("part"))
        for a, b in chunks(texts):
            sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            start = np.cumsum(sizes) - sizes
            grams = Levels(np.frombuffer(b"".join(texts[a:b]), np.uint8)).all(q).view(np.int64)
            part, window = inside(last[a:b] - first[a:b] + 1)
            ahead = np.zeros(len(grams), np.int32)
            for j, o in enumerate(behind):
                ahead[start[part] + window + o] |= 1 << j
            asked = np.flatnonzero(ahead)
            own = np.searchsorted(start, asked, side="right") - 1
            yield pa.record_batch([pa.array(base[a:b][own] + asked - start[own], pa.int64()), pa.array(ahead[asked]), pa.array(grams[asked])], ["at", "ahead", "gram"])

    return map_arrow(parts, run, "at long, ahead int, gram long")


def repeated(parts: DataFrame, length: int) -> DataFrame:
    """(at): the addresses of the windows of ``parts`` that occur twice at least among them."""
    _, later = steps(length)
    behind = offsets(later)

    def buckets(table: DataFrame, keys: list[str]) -> DataFrame:
        """Members with the pointer of their bucket; those that are alone are left out."""
        found = table.groupBy(*keys).agg(F.min("at").alias("pointer"), F.count(F.lit(1)).alias("size")).where("size > 1")
        return store(attach(table, found, keys, "size").select("at", "ahead", F.col("pointer")), "pointers")

    def standing(places: set[int]):
        return F.col("ahead").bitwiseAND(F.lit(sum(1 << j for j, o in enumerate(behind) if o in places))) != 0

    level = buckets(store(suffixes(parts, length), "suffixes"), ["gram"])
    for k, step in enumerate(later):
        wanted = set(offsets(later[k + 1 :]))
        own = level.where(standing(wanted)).withColumnRenamed("pointer", "own")
        beyond = level.where(standing({o + step for o in wanted})).select((F.col("at") - step).alias("at"), F.col("pointer").alias("next"))
        level = buckets(store(own.join(beyond, "at"), "pairs"), ["own", "next"])
    return level.select("at")


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """id, tag, start, stop (bytes) of spans that together are all bytes covered by a repeated ``length``-byte string. ``documents`` as by
    ``keyed``."""
    settled, open_ = refine(store(runs(documents, length, gram, words=False), "runs").withColumn("weight", F.lit(1).cast("long")))
    parts = store(pieces(documents, open_, length, words=False), "parts")
    by_block, open_ = refine(store(_blocks(parts, length, gram, block), "blocks"))
    # a block left open is looked at window by window, inside its part
    inside = parts.select("id", "tag", F.col("first").alias("p_first"), F.col("last").alias("p_last"), "part")
    left = addressed(open_.join(inside, ["id", "tag"]).where("first >= p_first and last <= p_last").select(
        "id", "tag", "first", "last", F.expr(f"substring(part, first - p_first + 1, last - first + {length})").alias("part")
    ))
    each = left.select("id", "tag", "base", F.explode(F.sequence("first", "last")).alias("start"), "first")
    windows = each.select("id", "tag", "start", (F.col("base") + F.col("start") - F.col("first")).alias("at"))
    single = windows.join(repeated(left, length), "at", "left_semi").select("id", "tag", F.col("start").alias("first"), F.col("start").alias("last"))
    every = settled.union(by_block).union(single)
    return every.select("id", "tag", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. A null text is the empty text. Repeated rows are copies of
    each other, and lose what copies lose; rows with a null doc_id are documents too; an empty table gives no rows;
    other columns take no part."""
    prepare(docs.sparkSession)
    documents = keyed(docs)
    joined = with_spans(documents, repeated_spans(documents, length)).select("doc_id", "z", "size", "spans")

    def run(batch: pa.RecordBatch):
        rows: list[list] = [[], [], [], []]
        spans = batch.column("spans").to_pylist()
        for k, data in enumerate(unsqueeze(batch)):
            digest, at, removed = hashlib.sha256(), 0, 0
            starts, stops = merged(*unpack(spans[k])) if spans[k] else ((), ())
            for a, b in zip(starts, stops, strict=True):
                digest.update(data[at:a])
                removed += int(b - a)
                at = b
            digest.update(data[at:])
            for column, x in zip(rows, (len(data), removed, len(starts), digest.hexdigest()), strict=True):
                column.append(x)
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
