"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Documents come in batches. The index keeps what earlier batches held as sorted, immutable runs: tables bucketed and sorted by
fingerprint, each with a second fingerprint for verification and the least doc_id. A new batch is merge-joined with every run, verified, and
appended as a run of its own; ``FAN_IN`` runs of one tier are compacted into one of the next, with more buckets where it is larger. Inside the range of
one bucket count, the joins read runs in order and shuffle only the batch.

An index has a folder, with a list of its runs. ``FingerprintIndex.open`` takes it up again, in another application too, and ``deduplicate`` adds a batch of
documents, with all their windows, and says what earlier batches had.

``remove_repeats`` and ``clean`` work on a whole corpus at once, in batches of ascending doc_id. There all documents are known, so windows that can't
repeat needn't enter the index: by the anchors of ``spans``, windows whose core occurs in one document only are left out, and runs
of windows that are the same wherever their core occurs are settled together.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, attach, boxed, delete, keyed, map_arrow, prepare, shared_path, shuffles_let_go, store, unboxed, unsqueeze
from .rolling import Levels, word_values
from .spans import chunks, inside, merged, pieces, runs, unpack, with_spans

WINDOW, GRAM = 50, 25
#: The least number of batches of a whole corpus, and how many windows one has at most, about; runs of a tier that are compacted; rows of a bucket.
BATCHES, BATCH_WINDOWS, FAN_IN, BUCKET_ROWS = 4, 1 << 33, 3, 1 << 23
WINDOWS = "id long, tag long, start int, fp long, check long"


class FingerprintIndex:
    """Sorted immutable runs of (fp, check, least) under a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path or shared_path(spark, "index"), fan_in
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[tuple[str, int, int]] = []  # name, tier, buckets
        self.turn = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index that ``save`` left under a path."""
        prepare(spark)
        listed = spark.read.parquet(f"{path}/list")
        turn = listed.agg({"turn": "max"}).first()[0]
        out = cls(spark, path, fan_in=fan_in)
        out.turn = turn
        for r in listed.where(F.col("turn") == turn).orderBy("place").collect():  # one row a run
            if r["name"] is None:
                out.buckets = r.buckets
                continue
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} (fp BIGINT, check BIGINT, least BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {r.buckets} BUCKETS LOCATION '{path}/{r['name']}'")
            out.runs.append((r["name"], r.tier, r.buckets))
        return out

    def save(self) -> None:
        """Writes the list of runs; what a failed call has left behind isn't in it."""
        self.turn += 1
        rows = [(-1, None, 0, self.buckets), *((k, *r) for k, r in enumerate(self.runs))]
        self.spark.createDataFrame(rows, "place int, name string, tier int, buckets int").coalesce(1).write.parquet(f"{self.path}/list/turn={self.turn}")

    def drop(self) -> None:
        """Removes the index, files and all."""
        for name, _, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []
        delete(self.spark, self.path)

    def _write(self, rows: DataFrame, tier: int, buckets: int) -> None:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        with shuffles_let_go(self.spark):
            rows.repartition(buckets, "fp").write.bucketBy(buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.runs.append((name, tier, buckets))

    def probe(self, batch: DataFrame) -> DataFrame:
        """``batch`` with ``before``: the least document of earlier batches with that (fp, check), or null."""
        out = batch.withColumn("before", F.lit(None).cast("long"))
        for name, _, _ in self.runs:
            run = self.spark.table(name).select(F.col("fp").alias("r_fp"), F.col("check").alias("r_check"), F.col("least").alias("r_least"))
            # equal fingerprints are candidates; the second fingerprint verifies them
            out = out.join(run.hint("merge"), (F.col("fp") == F.col("r_fp")) & (F.col("check") == F.col("r_check")), "left")
            out = out.withColumn("before", F.least("before", "r_least")).drop("r_fp", "r_check", "r_least")
        return out

    def add(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """The windows of ``rows`` (the columns of WINDOWS) that an earlier batch has, or a document of smaller id of this one. The batch then belongs to
        the index, but for the ``last`` one before it is dropped."""
        own = rows.groupBy("fp", "check").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
        known = store(self.probe(own), "batch")
        met = known.where("before is not null or size > 1")
        hits = store(attach(rows, met, ["fp", "check"], "size").where("before is not null or id > least").select("id", "tag", "start"), "hits")
        if not last:
            self._write(known.where("before is null").select("fp", "check", "least"), 0, self.buckets)
            self.compact()
        return hits

    def compact(self) -> None:
        tier = 0
        while len(same := [r for r in self.runs if r[1] == tier]) >= self.fan_in:
            every = self.spark.table(same[0][0])
            for name, _, _ in same[1:]:
                every = every.union(self.spark.table(name))
            buckets = max(r[2] for r in same)
            while every.count() > buckets * BUCKET_ROWS:
                buckets *= 2
            self._write(every.groupBy("fp", "check").agg(F.min("least").alias("least")), tier + 1, buckets)
            for run in same:
                self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
                delete(self.spark, f"{self.path}/{run[0]}")
                self.runs.remove(run)
            tier += 1


def _hashed(texts: list[bytes], ids: np.ndarray, tags: np.ndarray, firsts: np.ndarray, window: int):
    """Batches of WINDOWS: the windows of some texts, whose first word is the ``firsts``-th of its document."""
    for a, b in chunks(texts):
        words = [t.split() for t in texts[a:b]]
        values = word_values([w for own in words for w in own])
        sizes = np.fromiter(map(len, words), np.int64, b - a)
        start = np.cumsum(sizes) - sizes
        text, place = inside(np.maximum(sizes - window + 1, 0))
        at = start[text] + place
        fp, check = Levels(values, 0).all(window)[at], Levels(values, 1).all(window)[at]
        columns = (ids[a:b][text], tags[a:b][text], place + firsts[a:b][text], fp.view(np.int64), check.view(np.int64))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for k in range(0, len(text), 50_000):
            yield pa.record_batch([pa.array(c[k : k + 50_000]).cast(t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in WINDOWS.split(", ")])


def _windows(parts: DataFrame, window: int) -> DataFrame:
    """The windows of each part, with two fingerprints."""

    def run(batch: pa.RecordBatch):
        ids, tags, firsts = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        yield from _hashed(as_bytes(batch.column(5)), ids, tags, firsts, window)

    return map_arrow(parts, run, WINDOWS)


def all_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every window of ``documents`` (as by ``keyed``), with two fingerprints."""

    def run(batch: pa.RecordBatch):
        ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        yield from _hashed(as_bytes(batch.column(3)), ids, tags, np.zeros(len(ids), np.int64), window)

    return map_arrow(documents, run, WINDOWS)


def earlier_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """id, tag, start, stop (words) of spans that together are all words covered by a window that also starts in a document of smaller id."""
    spark = documents.sparkSession
    units = store(runs(documents, window, gram, words=True), "runs")
    buckets = units.groupBy("core").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("hull").alias("low"), F.max("hull").alias("high"), F.count(F.lit(1)).alias("size"))
    active = store(attach(units, buckets.where("least < most").drop("most"), ["core"], "size").drop("size"), "active")
    columns = ["id", "tag", "first", "last"]
    settled = active.where("low = high and id > least").select(*columns)
    mixed = active.where("low <> high")
    heads = mixed.groupBy("core", "hull").agg(F.min("id").alias("lowest"), F.count(F.lit(1)).alias("size"))
    placed = store(attach(mixed, heads, ["core", "hull"], "size").select(*columns, "lowest"), "placed")
    repeats = placed.where("id > lowest").select(*columns)
    # every place of the run in its least document, not the first alone: what meets the index there counts for that place only
    open_ = placed.where("id = lowest").select(*columns, F.lit(1).cast("long").alias("weight"))
    windows = store(_windows(pieces(documents, open_, window, words=True), window), "windows")
    batches = max(batches, -(-windows.count() // BATCH_WINDOWS))
    edges = windows.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000).alias("e")).first()["e"] or []
    edges = [None, *sorted(set(edges)), None]
    index = FingerprintIndex(spark)
    every = settled.union(repeats)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = windows
        if low is not None:
            rows = rows.where(F.col("id") > low)
        if high is not None:
            rows = rows.where(F.col("id") <= high)
        hits = index.add(rows, last=high is None)
        every = every.union(hits.select("id", "tag", F.col("start").alias("first"), F.col("start").alias("last")))
    index.drop()
    return every.select("id", "tag", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))


def _kept(data: bytes, spans: list | None) -> tuple[int, int, list[bytes] | None]:
    """Words, words removed, and the words kept (None where none is removed)."""
    if not spans:
        return len(data.split()), 0, None
    words = data.split()
    gone = np.zeros(len(words), bool)
    for a, b in zip(*merged(*unpack(spans)), strict=True):
        gone[a:b] = True
    return len(words), int(gone.sum()), [w for w, g in zip(words, gone, strict=True) if not g]


def _judged(documents: DataFrame, spans: DataFrame) -> DataFrame:
    joined = with_spans(documents, spans).select("doc_id", "z", "size", "spans")

    def run(batch: pa.RecordBatch):
        rows: list[list] = [[], [], []]
        spans_ = batch.column("spans").to_pylist()
        for k, data in enumerate(unsqueeze(batch)):
            n, removed, kept = _kept(data, spans_[k])
            rows[0].append(n)
            rows[1].append(removed)
            rows[2].append(hashlib.sha256(b" ".join(data.split() if kept is None else kept)).hexdigest())
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row. A null text has no words. Rows with a null doc_id come after all
    others, and none of them is before another; nor is one of several rows with the same doc_id. An empty table gives no rows; other
    columns take no part."""
    prepare(docs.sparkSession)
    documents = keyed(docs)
    return _judged(documents, earlier_spans(documents, window, batches=batches))


def deduplicate(index: FingerprintIndex, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``remove_repeats`` for one batch, against itself and all that ``index`` holds, whose documents all count as earlier; adds the batch to the index, and
    saves that."""
    prepare(docs.sparkSession)
    documents = keyed(docs)
    hits = index.add(store(all_windows(documents, window), "windows"))
    index.save()
    return _judged(documents, hits.select("id", "tag", "start", (F.col("start") + window).alias("stop")))


def clean(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated words taken out of text (and n_chars, where there is one, made to fit). Texts that lose nothing stay as they are, byte by
    byte, null and empty ones too; a text that loses every word goes. Rows with a null or repeated doc_id as in ``remove_repeats``; an empty table gives no rows;
    other columns are carried as they are, whatever their names."""
    prepare(docs.sparkSession)
    documents = keyed(docs)
    own = boxed(docs, F.xxhash64("text"))
    joined = with_spans(own, earlier_spans(documents, window, batches=batches)).select("row", "z", "size", "spans")

    def run(batch: pa.RecordBatch):
        spans_ = batch.column("spans").to_pylist()
        texts = unsqueeze(batch)
        keep = [True] * len(texts)
        for k, found in enumerate(spans_):
            if found:
                _, _, kept = _kept(texts[k], found)
                texts[k] = b" ".join(kept)
                keep[k] = bool(kept)
        yield pa.record_batch([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"]).filter(pa.array(keep, pa.bool_()))

    out = unboxed(map_arrow(joined, run, own.select("row", "text").schema), docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
