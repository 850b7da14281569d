"""Rules on repetition: what share of a text stands in repeated n-grams and repeated lines.

Words become 64-bit hashes, n-grams of several lengths rolling hashes over them, all in numpy; a word is
covered where some n-gram over it occurs at least twice in the text, and coverage is counted in characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, as_bytes, keep_rows, map_arrow, prepare
from .rolling import Levels, word_values

#: The largest share of a text's characters that may stand in repeated n-grams of each length, and in repeated lines.
NGRAM_SHARES = {5: 0.30, 7: 0.25, 10: 0.20}
LINE_SHARE = 0.30
BASE_WINDOW, BASE_SHARE, LEAST_WORDS = 5, 20, 10
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, " + ", ".join(f"share_{n} double" for n in NGRAM_SHARES)


def covered(words: Levels, n: int) -> np.ndarray:
    """Which words stand in an n-gram that occurs at least twice."""
    grams = words.all(n)
    out = np.zeros(words.n + 1, np.int64)
    if len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        np.add.at(out, at, 1)
        np.add.at(out, at + n, -1)
    return np.cumsum(out)[:-1] > 0


def measure(data: bytes) -> tuple:
    """The measures of one UTF-8 text, in the order of SCHEMA from n_words on."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~WHITE[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first_byte = (raw & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(first_byte & inside)))
    sizes = points[stop] - points[start]
    n, chars = len(start), int(sizes.sum())
    words = Levels(word_values(data.split()))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\v\f\r"):
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode()) for w in line.split())
            seen.add(line)
    shares, repeated = [], 0
    for length in NGRAM_SHARES:
        over = covered(words, length)
        if length == BASE_WINDOW:
            repeated = int(over.sum())
        shares.append(float(sizes[over].sum()) / chars if chars else 0.0)
    line_share = dup_chars / chars if chars else 0.0
    failed = n < LEAST_WORDS or 100 * repeated > BASE_SHARE * n
    kept = not failed and line_share <= LINE_SHARE and all(s <= most for s, most in zip(shares, NGRAM_SHARES.values(), strict=True))
    return n, chars, len(_SYMBOLS.findall(data)), dup_lines, repeated, failed, kept, line_share, *shares


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every whole text, a row for each row. A null text has no words and fails; a repeated row is judged
    each time; a null doc_id stays null; an empty table gives no rows; other columns take no part."""

    def run(batch: pa.RecordBatch):
        names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
        columns = list(zip(*map(measure, as_bytes(batch.column(1))), strict=True))
        yield pa.record_batch([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *names])

    prepare(docs.sparkSession)
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns as they are. The verdict is taken on the row itself, with no join: a null or empty
    text goes, repeated rows stay or go together, an id, null or not, doesn't matter, an empty table gives no rows."""
    prepare(docs.sparkSession)
    return keep_rows(docs, ["text"], lambda texts: [measure(x)[6] for x in as_bytes(texts)])
