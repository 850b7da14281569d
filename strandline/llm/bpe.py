"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A byte-pair merge list whose every merge uses only parts made by earlier merges
has a *sufficient lookahead*: a number L so that a token boundary that ends L bytes
before the end of what has been read can no longer change, whatever follows. The
encoder computes L from the merge list, reads a window of the current
pre-token, encodes it, emits the tokens whose end is more than L bytes from the end of
the window, and continues behind the last one. Memory is the window, however long a
run of letters is.

Why L suffices. Let two inputs agree before byte p. Apply the merges in order. The
leftmost boundary at which the two runs differ moves left only if a merge (u, v) takes
place in one run and not in the other, over that boundary: it moves to the boundary
between u and v. The right part v then begins with the token on which
the previous move ended (the earlier left part), so moves form a chain of ever later merges in
which each right part begins with the previous left part. L is the largest sum over such chains
of the first right part and of all left parts.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, prepare
from .merging import MergeTable

#: Fixed values of the byte-level pre-tokenizer: its pattern, and the white space it knows.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\t-\r \x85\xa0  -     　"
#: Python's own idea of white space has four more characters, so the pattern is spelled out.
_INNER = regex.compile(PRETOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"))
#: A coarser cut whose pieces never share a pre-token: words with the space before them.
_OUTER = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 400_000
#: Texts beyond so many characters are cut into words lazily, so many words at a time.
BLOCK_CHARS, BLOCK_WORDS = 1 << 17, 1 << 14


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the
    others follow from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """L of the module's text. Raises ValueError if a merge uses a part that no earlier one makes."""
    made: set[bytes] = set()
    by_left: dict[bytes, int] = {}  # left part -> largest chain that ends in a merge with that left part
    most = 0
    for left, right in merges:
        for part in (left, right):
            if len(part) > 1 and part not in made:
                raise ValueError(f"merge of {left!r} and {right!r} comes before its part {part!r}")
        chain = len(right)
        for n in range(1, len(right) + 1):
            chain = max(chain, by_left.get(right[:n], 0))
        chain += len(left)
        by_left[left] = max(by_left.get(left, 0), chain)
        most = max(most, chain)
        made.add(left + right)
    return most


class ByteBPE:
    """Encoder and decoder of one vocabulary file, loaded once a worker."""

    _loaded: dict[str, ByteBPE] = {}

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        if path not in cls._loaded:
            with open(path, encoding="utf-8") as f:
                cls._loaded[path] = cls(json.load(f))
        return cls._loaded[path]

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.lookahead = sufficient_lookahead(pairs)
        self.window = max(1024, 4 * self.lookahead)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.words: dict[str, bytes] = {}
        self.table = MergeTable([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs])
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one byte string: lowest-ranked pair first, leftmost of equals."""
        if not data:
            return []
        return self.table.merge(self.of_byte[np.frombuffer(data, np.uint8)], np.array([len(data)]))[0].tolist()

    def stream(self, data: bytes) -> Iterator[int]:
        """The ids of one pre-token, read through a window: tokens go out once they are stable."""
        at, width = 0, self.window
        while len(data) - at > width:
            stable, end = width - self.lookahead, 0
            for i in self.merge(data[at : at + width]):
                size = len(self.bytes_of[i])
                if end + size > stable:
                    break
                end += size
                yield i
            at += end
        yield from self.merge(data[at:])

    def make_room(self, n: int) -> None:
        """When the words kept are too many, the half met longest ago goes: memory stays bounded."""
        if len(self.words) + n > CACHE_WORDS:
            names = list(self.words.items())
            self.words = dict(names[max(len(names) // 2, len(names) + n - CACHE_WORDS) :])

    def learn(self, words: set[str]) -> None:
        """Encodes words that the cache lacks, all at once; long pre-tokens go through ``stream``."""
        short: list[bytes] = []
        owner: list[int] = []
        names = list(words)
        odd: list[int] = []
        for k, word in enumerate(names):
            if word.isalpha() or (word[0] == " " and word[1:].isalpha()):
                parts = [word.encode()]
            else:
                parts = [p.encode() for p in _INNER.findall(word)]
            if max(map(len, parts)) > self.window:
                odd.append(k)
                continue
            short += parts
            owner += [k] * len(parts)
        counts = np.zeros(len(names), np.int64)
        ids = np.zeros(0, np.int32)
        if short:
            ids, sizes = self.table.merge(self.of_byte[np.frombuffer(b"".join(short), np.uint8)], np.fromiter(map(len, short), np.int64, len(short)))
            np.add.at(counts, np.array(owner), sizes)
        raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        at = 0
        for word, end in zip(names, ends, strict=True):
            self.words[word] = raw[at:end]
            at = end
        for k in odd:
            self.words[names[k]] = b"".join(np.fromiter(self.stream(p.encode()), np.uint32).astype("<u4").tobytes() for p in _INNER.findall(names[k]))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in pieces."""
        pieces = self.split_special.split(text) if self.split_special and "<" in text else [text]
        for piece in pieces:
            if not piece:
                continue
            if piece in self.special:
                yield self.special[piece].to_bytes(4, "little")
                continue
            for block in self.blocks(piece):
                self.make_room(len(block))
                if missing := set(block).difference(self.words):
                    self.learn(missing)
                yield b"".join(map(self.words.__getitem__, block))

    @staticmethod
    def blocks(piece: str) -> Iterator[list[str]]:
        if len(piece) <= BLOCK_CHARS:
            yield _OUTER.findall(piece)
            return
        found = _OUTER.finditer(piece)
        while block := [m[0] for m in islice(found, BLOCK_WORDS)]:
            yield block

    def encode_many(self, texts: list[str]) -> Iterator[Iterable[bytes]]:
        """``encode`` of each text, the words of short ones learnt together, which is cheaper than text by text."""
        plain = [len(t) <= BLOCK_CHARS and not (self.split_special and self.split_special.search(t)) for t in texts]
        words = [_OUTER.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        new = set().union(*words).difference(self.words)
        self.make_room(len(new))
        if new:
            self.learn(new)
        for text, p, block in zip(texts, plain, words, strict=True):
            if not p:
                yield self.encode(text)
                continue
            try:
                yield (b"".join(map(self.words.__getitem__, block)),)
            except KeyError:  # a word went while room was made
                yield self.encode(text)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text from ids, in pieces: the state between pieces is the beginning of one character at most."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        block, bytes_of = [], self.bytes_of
        for i in ids:
            block.append(bytes_of[i])
            if len(block) >= 8192:
                yield state.decode(b"".join(block))
                block.clear()
        yield state.decode(b"".join(block), True)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text. Per row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded text). A null text is the empty text: 0 tokens, and the digests of
    nothing. Repeated rows each give their row, a null doc_id stays null, an empty table gives no rows; other columns
    take no part."""

    def run(batch: pa.RecordBatch):
        bpe = ByteBPE.load(path)
        counts, coded, decoded = [], [], []
        texts = [x.decode() for x in as_bytes(batch.column(1))]
        for k in range(0, len(texts), 100):
            for pieces in bpe.encode_many(texts[k : k + 100]):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                state = codecs.getincrementaldecoder("utf-8")("replace")
                token = bpe.bytes_of.__getitem__
                for piece in pieces:
                    ids = np.frombuffer(piece, "<u4").tolist()
                    n += len(ids)
                    ids_hash.update(piece)
                    text_hash.update(state.decode(b"".join(map(token, ids))).encode())
                text_hash.update(state.decode(b"", True).encode())
                counts.append(n)
                coded.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Every column of ``docs`` but text, then ids array<int>. A null text is the empty text, and has no ids.
    Repeated rows each give their row; other columns are carried as they are, a column ``ids`` is replaced."""

    def run(batch: pa.RecordBatch):
        bpe = ByteBPE.load(path)
        ids = [np.frombuffer(b"".join(bpe.encode(x.decode())), "<i4") for x in as_bytes(batch.column("text"))]
        keep = [n for n in batch.schema.names if n not in ("text", "ids")]
        yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    prepare(docs.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("text", "ids")]
    return map_arrow(docs, run, ", ".join([*kept, "ids array<int>"]))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Every column of ``coded`` but ids, then text: ids array<int> turned back. Null ids give the empty text; bytes that
    are no UTF-8 become U+FFFD."""

    def run(batch: pa.RecordBatch):
        bpe = ByteBPE.load(path)
        texts = ["".join(bpe.decode(x or [])) for x in batch.column("ids").to_pylist()]
        keep = [n for n in batch.schema.names if n not in ("text", "ids")]
        yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "text"])

    prepare(coded.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name not in ("text", "ids")]
    return map_arrow(coded, run, ", ".join([*kept, "text string"]))
