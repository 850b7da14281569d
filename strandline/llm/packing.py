"""Packing documents into sequences: best-fit decreasing, certified by lower bounds and repaired by exchange.

Each document becomes token ids and an end id, cut only where longer than a sequence. Pieces are dealt into
groups of bounded size; each group packs its own by best-fit decreasing and compares
its bins with a lower bound from dual-feasible functions. Where bins and bound differ, the
pieces of the group's unfilled bins are exchanged: they go into fewer groups, dealt anew, and are packed again; a
new packing counts where it saves bins. Rounds end when the bound is met or nothing is saved.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import WHITE, as_bytes, cut, map_arrow, prepare
from .merging import MergeTable
from .spans import chunks, inside

SEQUENCE, END_ID = 4096, 1
#: Pieces a group holds, on average; what one task packs.
GROUP_PIECES = 50_000
ROUNDS = 3
CACHE_WORDS = 400_000
#: Bytes encoded together, but for a longer single text.
ENCODED = 1 << 20
#: How this vocabulary's file splits lower-cased text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRETOKEN = regex.compile(PRETOKEN)
_SPACE = regex.compile(rb"[ \t-\r]")
PIECES = "doc_id long, tag int, copy long, piece int, start long, length long, ids_crc32 long"


#: Kinds of characters up to the last of Latin Extended-B: ASCII white space, letters, numbers, other signs; all else is the rest, as are those
#: that another character may stand for once they are composed and lower-cased.
_WHITE, _LETTER, _NUMBER, _SIGN, _REST = range(5)
LATIN = 0x250


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each character, and its lower-cased form."""
    kind, low = np.full(LATIN + 1, _REST, np.uint8), np.arange(LATIN + 1, dtype=np.uint32)
    for c in map(chr, range(LATIN)):
        own = c.lower()
        if c.isprintable() and not c.isspace() and unicodedata.normalize("NFC", c) == c and len(own) == 1 and ord(own) < LATIN:
            kind[ord(c)] = _LETTER if regex.match(r"\p{L}", own) else _NUMBER if regex.match(r"\p{N}", own) else _SIGN
            low[ord(c)] = ord(own)
    kind[np.flatnonzero(WHITE)] = _WHITE
    return kind, low


_KIND, _LOW = _kinds()


def units(text: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What a text falls into before its parts are merged, as UTF-8: the lower-cased pre-tokens of words without characters of the rest, and other words
    whole, as they are. Also whether each is such a word, and its place in ``text``."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _KIND[np.minimum(raw, LATIN)]
    places = np.flatnonzero(kind)
    if not len(places):
        return pa.array([], pa.binary()), np.zeros(0, bool), places
    kind, raw = kind[places], raw[places]
    begins = np.concatenate(([True], np.diff(places) > 1))  # of words
    rest = np.zeros(len(kind), bool)
    if kind.max() == _REST:
        word = np.flatnonzero(begins)
        rest = np.repeat(np.maximum.reduceat(kind, word) == _REST, np.diff(np.append(word, len(kind))))
        kind[rest] = _REST
    low = np.where(rest, raw, _LOW[np.minimum(raw, LATIN)])
    new = begins | (kind == _NUMBER)
    new[1:] |= kind[1:] != kind[:-1]
    # an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it, whatever follows
    quote = np.flatnonzero((low == ord("'")) & new & ~rest)
    if len(quote):
        after, ends = np.append(low, (0, 0)), np.append(begins, (True, True))
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~ends[quote + 1]
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        long &= ~ends[quote + 1] & ~ends[quote + 2]
        new[quote[short | long] + 1] = False
        stop = np.concatenate((quote[short] + 2, quote[long] + 3))
        new[stop[stop < len(new)]] = True
    first = np.flatnonzero(new)
    data = low.astype("<u4").tobytes().decode("utf-32-le").encode()
    # where the characters begin among the bytes
    at = first if len(data) == len(low) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[first]
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), rest[first], places[first]


def at_white(text: bytes, most: int) -> Iterator[bytes]:
    """``text`` in parts that begin at white space, cut where they reach ``most`` bytes: what the arrays of a worker hold for a very long text."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class WordBPE:
    """Ids of texts under a lower-casing vocabulary with word ends. White space always separates, so ids are kept by pre-token, or
    by word where one has more than Latin letters and signs; words beyond Latin letters go through the tokenizer library itself."""

    _loaded: dict[str, WordBPE] = {}

    @classmethod
    def load(cls, path: str) -> WordBPE:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @classmethod
    def forget(cls) -> None:
        """Lets go the words learnt: a worker that waits for its next task needn't hold them."""
        for bpe in cls._loaded.values():
            bpe.words = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.table = MergeTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letter = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letter[b] + end] for b in range(256)], np.int32)
        self.words: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, found: list[bytes], rest: list[bool]) -> list[bytes]:
        """The ids of each of these, which are as by ``units``."""
        parts: list[bytes] = []
        numbers: list[int] = []
        long: dict[int, bytes] = {}
        for k, (unit, is_word) in enumerate(zip(found, rest, strict=True)):
            if len(unit) > 256 or is_word and max(unit.decode()) > "ɏ":
                long[k] = self.whole(unit.decode())
                numbers.append(0)
            elif is_word:
                own = [p.encode() for p in _PRETOKEN.findall("".join(c.lower() for c in unicodedata.normalize("NFC", unit.decode())))]
                parts += own
                numbers.append(len(own))
            else:
                parts.append(unit)
                numbers.append(1)
        if not parts:
            return [long.get(k, b"") for k in range(len(found))]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        tokens = self.inner[data]
        ends = np.cumsum(sizes) - 1
        tokens[ends] = self.final[data[ends]]
        ids, got = self.table.merge(tokens, sizes)
        raw = ids.astype("<u4").tobytes()
        edges = (4 * np.concatenate(([0], np.cumsum(got)))[np.concatenate(([0], np.cumsum(numbers)))]).tolist()
        out = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k, x in long.items():
            out[k] = x
        return out

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > ENCODED and b"<|" not in texts[0]:
            return [b"".join(self._encode([part])[0] for part in at_white(texts[0], ENCODED))]
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        whole = [b"<|" in t for t in texts]
        plain = ["" if w else t.decode() for t, w in zip(texts, whole, strict=True)]
        found, rest, places = units("\n".join(plain))
        codes = found.dictionary_encode()
        distinct, code = codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy()
        ids = list(map(self.words.get, distinct))
        missing = [k for k, x in enumerate(ids) if x is None]
        if len(self.words) + len(missing) > CACHE_WORDS:
            kept = list(self.words.items())
            self.words = dict(kept[len(kept) // 2 :] if len(kept) // 2 + len(distinct) <= CACHE_WORDS else [])
        if missing:
            is_word = np.zeros(len(distinct), bool)
            is_word[code] = rest
            for k, x in zip(missing, self.learn([distinct[k] for k in missing], is_word[missing].tolist()), strict=True):
                ids[k] = x
            self.words.update(zip([distinct[k] for k in missing], [ids[k] for k in missing], strict=True))
        # the ids of all texts one after another: those of each unit, from where it stands in those of the distinct units
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        unit, k = inside(sizes[code])
        flat = np.frombuffer(b"".join(ids), "<u4")[(np.cumsum(sizes) - sizes)[code][unit] + k]
        starts = np.cumsum([0, *(len(t) + 1 for t in plain)])
        edges = np.searchsorted(unit, np.searchsorted(places, starts)).tolist()
        return [self.whole(t.decode()) if w else flat[a:b].tobytes() for t, w, a, b in zip(texts, whole, edges[:-1], edges[1:], strict=True)]


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document: its place, length and checksum."""
    end = END_ID.to_bytes(4, "little")

    def run(batch: pa.RecordBatch):
        bpe = WordBPE.load(path)
        rows: list[list] = [[], [], [], [], [], [], []]
        texts, ids = as_bytes(batch.column(3)), batch.column(0).to_pylist()
        tags, copies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in chunks(texts, ENCODED):
            for j, raw in enumerate(bpe.encode_many(texts[a:b]), a):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for column, x in zip(rows, (ids[j], tags[j], copies[j], p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "tag", "copy", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), F.monotonically_increasing_id().alias("copy"), "text")
    return map_arrow(source, run, PIECES, WordBPE.forget)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs, from dual-feasible functions: for each threshold t, a piece longer than size - t counts as a whole
    bin, one shorter than t as nothing, others as their length; and the stepwise functions floor((k + 1) x) / k."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    values = np.arange(size + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * values)
    best = -(-int(mass[-1]) // size)
    t = np.arange(1, size // 2 + 1)
    whole = number[-1] - number[size - t]
    middle = mass[size - t] - mass[t - 1]
    best = max(best, int((whole + -(-middle // size)).max()))
    for k in range(1, 20):
        x = (k + 1) * values
        step = np.where(x % size == 0, values * k, (x // size) * size)  # size * k times the function
        best = max(best, -(-int((counts * step).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each piece. Equal lengths are taken in their given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    gaps: list[int] = []  # distinct gaps that some bin has, ascending
    with_gap: dict[int, list[int]] = {}
    n_bins = 0
    for k in order.tolist():
        need = int(lengths[k])
        at = bisect_left(gaps, need)
        if at < len(gaps):
            gap = gaps[at]
            have = with_gap[gap]
            b = have.pop()
            if not have:
                del with_gap[gap]
                gaps.pop(at)
        else:
            b, gap = n_bins, size
            n_bins += 1
        bins[k], offsets[k] = b, size - gap
        if rest := gap - need:
            if rest not in with_gap:
                with_gap[rest] = []
                insort(gaps, rest)
            with_gap[rest].append(b)
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long, gap int"


def _pack(rows: DataFrame, groups: int, turn: int, size: int) -> DataFrame:
    """Deals rows into groups and packs each. gap: 1 where the row's bin is to be exchanged."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["g"].iloc[0])
        frame = frame.drop(columns="g").sort_values(["doc_id", "tag", "copy", "piece"], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit(lengths, size)
        load = np.bincount(bins, weights=lengths)
        gap = int(load.size > lower_bound(lengths, size)) * (load[bins] < size)
        return frame.assign(sequence_id=(turn << 56) + (group << 24) + bins, offset=offsets, gap=gap.astype(np.int32))

    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "tag", "copy", "piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, PACKED)


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Packs every document (a null text is the empty text: the end id alone) into sequences of at most ``size``
    tokens. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and certified: whether the piece's
    group met its lower bound or was exchanged. Repeated rows are packed each; a null doc_id stays null; an
    empty table gives no rows."""
    spark = docs.sparkSession
    todo = cut(pieces(docs, path, size))
    n = todo.count()
    done: list[DataFrame] = []
    for turn in range(rounds):
        groups = max(1, -(-n // group_pieces))
        packed = cut(_pack(todo, groups, turn, size))
        open_ = packed.where("gap = 1")
        n_open = open_.count()
        if turn:  # an exchange counts only where it saves bins
            before = todo.select("sequence_id").distinct().count()
            after = packed.select("sequence_id").distinct().count()
            if after >= before:
                done.append(todo.withColumn("gap", F.lit(1)))
                break
        if not n_open or n_open == n or turn + 1 == rounds or groups == 1:
            done.append(packed)
            break
        done.append(packed.where("gap = 0"))
        todo, n = open_, n_open
    out = done[0].select("*")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("gap") == 0).alias("certified"))


def utilisation(packed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """One row: sequences, tokens and the share of places filled."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")).withColumn("filled", F.try_divide(F.col("tokens"), F.col("sequences") * size))
