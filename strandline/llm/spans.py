"""Candidate spans for exact substring search, and cutting spans out of texts.

Every window of W symbols (bytes, or words) has an anchor: of the q-grams inside it, the leftmost of least hash. Equal
windows have equal anchors at equal places, so only documents' anchors, one per many
windows, are shuffled. A row stands for a run of windows with one anchor: ``core`` is the hash of what all its windows share,
``hull`` that of all they cover. A core met once rules its windows out; a core whose rows all have one
hull settles them; what is left open goes on to smaller units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, as_bytes, hot_keys, map_arrow, salted, squeeze, unsqueeze
from .rolling import Levels, anchors, distinct_values, word_values

#: Bytes hashed together: bounds the arrays of a worker, but for a longer single text.
CHUNK = 1 << 18
RUNS = "id long, tag long, first int, last int, core long, hull long"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word in an array of bytes."""
    edge = np.diff(np.concatenate(([False], ~WHITE[raw], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and hash of each word in an array of bytes. Distinct words are found in Arrow, and only those are hashed."""
    start, stop = word_edges(raw)
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~WHITE[raw]])]).dictionary_encode()
    return start, stop, distinct_values(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]


def symbols(data: bytes, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of UTF-8 bytes (the bytes, or a hash of each word), and the place of each in the bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not words:
        return raw, np.arange(len(raw))
    return word_values(data.split()), word_edges(raw)[0]


def chunks(texts: list[bytes], most: int | None = None):
    """Index ranges of texts that are hashed together."""
    at, most = 0, most or CHUNK
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def runs(keyed_docs: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """A row per run of windows with one anchor; first and last are the run's windows, counted in symbols of their text."""

    def run(batch: pa.RecordBatch):
        ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        texts = as_bytes(batch.column(3))
        for a, b in chunks(texts):
            data = b"\n".join(texts[a:b])
            starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a : b - 1]]))).astype(np.int64)
            values, places = symbols(data, words)
            first_symbol = np.searchsorted(places, starts)
            ends = np.append(first_symbol[1:], len(values))
            if not words:
                ends[:-1] -= 1  # the line feed between two texts belongs to none
            levels = Levels(values)
            grams = levels.all(gram)
            owner, first, last = anchors(grams, window - gram + 1)
            if not len(owner):
                continue
            # a run over the border of two texts is cut back to windows inside one
            doc = np.searchsorted(first_symbol, owner, side="right") - 1
            first = np.maximum(first, first_symbol[doc])
            last = np.minimum(last, ends[doc] - window)
            good = (last >= first) & (owner + gram <= ends[doc])
            owner, first, last, doc = owner[good], first[good], last[good], doc[good]
            hull = levels.spans(first, last + window)
            base = first_symbol[doc]
            columns = (ids[a:b][doc], tags[a:b][doc], first - base, last - base, grams[owner].view(np.int64), hull.view(np.int64))
            for k in range(0, len(doc), 20_000):
                yield pa.record_batch([pa.array(c[k : k + 20_000]).cast(t) for c, t in zip(columns, _KINDS, strict=True)], [f.split()[0] for f in RUNS.split(", ")])

    return map_arrow(keyed_docs.select("id", "tag", "doc_id", "text"), run, RUNS)


def pieces(keyed_docs: DataFrame, open_runs: DataFrame, window: int, words: bool) -> DataFrame:
    """The bytes that each open run covers: id, tag, first, last and the columns of ``extra``. ``open_runs`` has id, tag, first, last, weight."""
    wanted = open_runs.groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last", "weight")).alias("wanted"))
    # rows that have the same id and tag are the same text: one of them a batch is enough
    joined = squeeze(keyed_docs.select("id", "tag", "text"), once=("id", "tag")).join(wanted, ["id", "tag"])

    def run(batch: pa.RecordBatch):
        rows: list[list] = [[], [], [], [], [], []]
        ids, tags, wanted_ = (batch.column(c).to_pylist() for c in ("id", "tag", "wanted"))
        for k, data in enumerate(unsqueeze(batch)):
            if words:
                start, stop = word_edges(np.frombuffer(data, np.uint8))
            for w in wanted_[k]:
                a, b = w["first"], w["last"] + window
                part = data[start[a] : stop[b - 1]] if words else data[a:b]
                for column, x in zip(rows, (ids[k], tags[k], w["first"], w["last"], w["weight"], part), strict=True):
                    column.append(x)
        if rows[0]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["id", "tag", "first", "last", "weight", "part"])

    return map_arrow(joined, run, "id long, tag long, first int, last int, weight long, part binary")


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal spans in order; spans that touch are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def with_spans(keyed_docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``keyed_docs`` or ``boxed`` ones, their text squeezed, with spans (array of start * 2**32 + stop, or null)."""
    packed = spans.select("id", "tag", (F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")).alias("span"))
    packed = packed.groupBy("id", "tag").agg(F.collect_set("span").alias("spans"))
    return salted(squeeze(keyed_docs), packed, ["id", "tag"], hot_keys(keyed_docs.select("id", "tag"), ["id", "tag"]), "left")


def unpack(values: list | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(values or [], np.int64)
    return found >> 32, found & 0xFFFFFFFF


def inside(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of members of groups: the group of each member, and its place there."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
