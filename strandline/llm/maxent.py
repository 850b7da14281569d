"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class). The first factor is a softmax over ``CLASSES`` classes with weights for
hashed features of the context: the previous word, the previous two, the word before the previous (a skip), and a bias.
Frequent words are dealt into classes of about equal mass, all others by their surface, so that unseen words have a class too. The second
factor is the word's share of its class in the training texts, with one added for each word of a surface class and one for the unseen.

Weights are trained by distributed gradient updates: in each round every task runs through its part of the training
texts in batches, and the tasks' changes are averaged by the number of their tokens, in a tree that grows with the number of tasks. Counts of words come from all training texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_arrow, prepare
from .spans import chunks, hashed_words

FREQUENT_CLASSES, SURFACE_CLASSES = 32, 16
CLASSES = FREQUENT_CLASSES + SURFACE_CLASSES
#: Words with classes of their own kind; words whose counts are sent to all tasks (the others are joined); both are fixed bounds.
FREQUENT, SENT = 4096, 1 << 18
BUCKETS = 1 << 13
#: Every round runs through all training texts.
ROUNDS, RATE, BATCH = 1, 0.5, 4096
#: The weights are summed in so many slices, and in a tree of so many branches a node.
SLICES, BRANCHES = 32, 8
#: Features that a batch has more than so often have their gradients summed one by one.
MANY = 32
END_WORD, START_WORD = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


class Tokens:
    """The tokens of some texts: hash and surface class of each, the text it belongs to, and where texts begin."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts).lower()
        raw = np.frombuffer(data, np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[:-1]]))).astype(np.int64)
        start, stop, words = hashed_words(raw)
        text = np.searchsorted(starts, start, side="right") - 1
        last = raw[stop - 1] if len(stop) else np.zeros(0, np.uint8)
        size = np.digitize(stop - start, (5, 8, 11))
        ending = np.select((last == 0x2E, last == 0x2C, (last >= 0x61) | ((last >= 0x30) & (last <= 0x39))), (0, 1, 2), 3)
        counts = np.bincount(text, minlength=len(texts))
        self.sizes = counts + 1
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        at = np.arange(len(words)) + text
        n = len(words) + len(texts)
        self.hash = np.full(n, END_WORD, np.uint64)
        self.hash[at] = words
        self.surface = np.full(n, SURFACE_CLASSES - 1, np.int64)
        self.surface[at] = size * 4 + ending
        self.text = np.repeat(np.arange(len(texts)), self.sizes)

    def features(self) -> np.ndarray:
        one = np.concatenate(([START_WORD], self.hash[:-1]))
        one[self.first] = START_WORD
        two = np.concatenate(([START_WORD], one[:-1]))
        two[self.first] = START_WORD
        mask = np.uint64(BUCKETS - 1)
        pair = (one * np.uint64(0x9E3779B97F4A7C15) + two) >> np.uint64(40)
        return np.stack(((one >> np.uint64(20)) & mask, pair & mask, (two * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(41)) & mask)).astype(np.int64)


class Lookup:
    """Word hashes to places in a table of fixed size, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.places[slot[todo]] < 0
            want = todo[free]
            self.places[slot[want]] = want
            self.keys[slot[want]] = keys[want]
            todo = todo[self.places[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.places[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.places[slot] >= 0))
        size = len(self.keys)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (size - 1)
            hit = (self.keys[slot[open_]] == keys[open_]) & (self.places[slot[open_]] >= 0)
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (self.places[slot[open_]] >= 0)]
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(train: DataFrame) -> DataFrame:
    """(word, surface, c): how often each token occurs in ``train`` (text). Counted in each task, then summed."""

    def run(batches):
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        kinds: list[np.ndarray] = []

        def fold():
            words, c, s = np.concatenate(held), np.concatenate(counts), np.concatenate(kinds)
            unique, first, inverse = np.unique(words, return_index=True, return_inverse=True)
            return unique, np.bincount(inverse, weights=c, minlength=len(unique)).astype(np.int64), s[first]

        def out(unique, c, s):
            for k in range(0, len(unique), 100_000):
                yield pa.record_batch([pa.array(unique[k : k + 100_000].view(np.int64)), pa.array(s[k : k + 100_000].astype(np.int32)), pa.array(c[k : k + 100_000])], ["word", "surface", "c"])

        size = 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts):
                t = Tokens(texts[a:b])
                unique, first, n = np.unique(t.hash, return_index=True, return_counts=True)
                held.append(unique)
                counts.append(n)
                kinds.append(t.surface[first])
                size += len(unique)
            if size > 4_000_000:
                folded = fold()
                if len(folded[0]) > 2_000_000:  # bounded memory: the shuffle sums what is sent in parts
                    yield from out(*folded)
                    held, counts, kinds, size = [], [], [], 0
                else:
                    held, counts, kinds, size = [folded[0]], [folded[1]], [folded[2]], len(folded[0])
        if held:
            yield from out(*fold())

    parts = train.select("text").mapInArrow(run, "word long, surface int, c long")
    return parts.groupBy("word").agg(F.min("surface").alias("surface"), F.sum("c").alias("c"))


def softmax_rows(w: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    logits = np.take(w, f[0], axis=0)
    for j in (1, 2):
        logits += np.take(w, j * BUCKETS + f[j], axis=0)
    logits += bias
    if not (logits.size and -60 < logits.min() <= logits.max() < 60):  # else exp can neither overflow nor vanish
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def sums_by_key(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in any order, how many of ``keys`` each is, the sum of ``rows[at]`` over them). Keys of many rows are summed one by one, all others
    together: the first row of every key, then the second of those that have one, and so on."""
    order = np.argsort(keys, kind="stable")
    own, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    size = np.diff(np.append(first, len(own)))
    longest = np.argsort(-size, kind="stable")
    first, size = first[longest], size[longest]
    many = int(np.searchsorted(-size, -MANY, side="left"))
    total = np.take(rows, at[first], axis=0)
    for k, (a, n) in enumerate(zip(first[:many].tolist(), size[:many].tolist(), strict=True)):
        total[k] = np.take(rows, at[a : a + n], axis=0).sum(axis=0)
    for r in range(1, int(size[many]) if many < len(size) else 0):
        n = int(np.searchsorted(-size, -r, side="left"))
        total[many:n] += np.take(rows, at[first[many:n] + r], axis=0)
    return own[first].astype(np.int64), size, total


class Model:
    """What tasks need: the counts of the most frequent words, classes, and the weights."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, surfaces: np.ndarray, class_mass: np.ndarray, class_words: np.ndarray):
        self.words, self.counts = words, counts
        n = min(FREQUENT, len(words))
        share = np.cumsum(counts[:n]) - counts[:n]
        frequent = np.minimum(FREQUENT_CLASSES - 1, share * FREQUENT_CLASSES // max(1, counts[:n].sum()))
        self.classes = np.concatenate((frequent, FREQUENT_CLASSES + surfaces[n:])).astype(np.int64)
        mass, number = np.zeros(CLASSES), np.zeros(CLASSES)
        np.add.at(mass, frequent, counts[:n])
        mass[FREQUENT_CLASSES:] = class_mass - np.bincount(surfaces[:n], weights=counts[:n], minlength=SURFACE_CLASSES)
        number[FREQUENT_CLASSES:] = class_words - np.bincount(surfaces[:n], minlength=SURFACE_CLASSES) + 1
        self.log_class = np.log10(np.maximum(1, mass + number))
        self.add = np.concatenate((np.zeros(FREQUENT_CLASSES), np.ones(SURFACE_CLASSES)))
        self.weights = np.zeros((3 * BUCKETS, CLASSES), np.float32)
        self.bias = np.log(np.maximum(mass, 0.5) / max(1.0, mass.sum())).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token in the table (or -1), and its class."""
        if "lookup" not in self.__dict__:
            self.lookup = Lookup(self.words)
        place = self.lookup.find(t.hash)
        return place, np.where(place >= 0, self.classes[place], FREQUENT_CLASSES + t.surface) if len(self.words) else FREQUENT_CLASSES + t.surface


def train_round(train: DataFrame, model: Model, rate: float) -> None:
    """One round over ``train``: tasks update copies of the weights, which are averaged."""
    shared = train.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        m = shared.value
        w, bias, seen = m.weights.copy(), m.bias.copy(), 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts):
                t = Tokens(texts[a:b])
                _, target = m.find(t)
                f = t.features()
                for k in range(0, len(target), BATCH):
                    ff, y = f[:, k : k + BATCH], target[k : k + BATCH]
                    g = softmax_rows(w, bias, ff)
                    g[np.arange(len(y)), y] -= 1
                    bias -= np.float32(rate) * g.mean(axis=0)
                    key = (ff + BUCKETS * np.arange(3)[:, None]).astype(np.uint16).ravel()
                    present, size, sums = sums_by_key(g, np.tile(np.arange(len(y)), 3), key)
                    # the mean gradient of a feature, trusted the more the oftener the batch has it
                    sums *= (rate / (size + 4)).astype(np.float32)[:, None]
                    w[present] = np.take(w, present, axis=0) - sums
                    seen += len(y)
        if seen:
            change = np.vstack((w - m.weights, (bias - m.bias)[None, :])) * np.float32(seen)
            for s, part in enumerate(np.array_split(change, SLICES)):
                yield pa.record_batch([pa.array([s]), pa.array([seen]), pa.array([part.astype("<f4").tobytes()])], ["slice", "seen", "change"])

    def add(frame):
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in frame["change"])
        return frame.iloc[:1].assign(seen=frame["seen"].sum(), change=[total.astype("<f4").tobytes()])

    schema = "slice long, part long, seen long, change binary"
    changes = train.select("text").mapInArrow(run, "slice long, seen long, change binary").select("slice", F.spark_partition_id().cast("long").alias("part"), "seen", "change")
    n = changes.rdd.getNumPartitions()
    while True:  # a frame holds BRANCHES rows at most, however many tasks there are
        changes, n = changes.withColumn("part", F.floor(F.col("part") / BRANCHES)).groupBy("slice", "part").applyInPandas(add, schema), -(-n // BRANCHES)
        if n <= 1:
            break
    rows = sorted(changes.collect(), key=lambda r: r.slice)  # one row a slice
    if rows:
        size = np.array_split(np.arange(3 * BUCKETS + 1), SLICES)
        change = np.vstack([np.frombuffer(r.change, "<f4").reshape(len(size[r.slice]), CLASSES) / r.seen for r in rows])
        model.weights += change[:-1].astype(np.float32)
        model.bias += change[-1].astype(np.float32)
    shared.destroy()


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows that are not held out. A null text
    is the empty text, which is one end token. Repeated rows count and score each; a null doc_id counts as the empty text for holding out and stays null. An
    empty table gives no rows; other columns take no part."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = cut(word_counts(train))
    by_kind = counts.groupBy("surface").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # SURFACE_CLASSES rows at most
    mass, number = np.zeros(SURFACE_CLASSES), np.zeros(SURFACE_CLASSES)
    for r in by_kind:
        mass[r.surface], number[r.surface] = r.c, r.n
    total, distinct = int(mass.sum()), int(number.sum())
    top = counts.orderBy(F.desc("c"), "word").limit(SENT).toArrow()
    model = Model(top["word"].to_numpy().view(np.uint64), top["c"].to_numpy(), top["surface"].to_numpy().astype(np.int64), mass, number)
    for _ in range(rounds):
        train_round(train, model, RATE)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size

    def run(batch: pa.RecordBatch):
        m = shared.value
        texts = as_bytes(batch.column(1))
        ids, outs = batch.column(0), batch.column(2)
        for a, b in chunks(texts):
            t = Tokens(texts[a:b])
            n = b - a
            place, kind = m.find(t)
            f = t.features()
            token = np.empty(len(kind))
            for k in range(0, len(kind), BATCH):
                p = softmax_rows(m.weights, m.bias, f[:, k : k + BATCH])
                token[k : k + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), kind[k : k + BATCH]], 1e-30))
            known = place >= 0
            c = np.where(known, m.counts[place], 0) if len(m.counts) else np.zeros(len(place))
            token -= m.log_class[kind]
            token += np.where(known, np.log10(np.maximum(c + m.add[kind], 1)), 0)
            rare = np.flatnonzero(~known)
            lists = np.concatenate(([0], np.cumsum(np.bincount(t.text[rare], minlength=n))))
            words = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(t.hash[rare].view(np.int64)))
            yield pa.record_batch(
                [
                    ids[a:b], outs[a:b],
                    pa.array(t.sizes.astype(np.int64)),
                    pa.array(np.bincount(t.text[known], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(t.text, weights=np.where(known, np.log10(c + 1), 0), minlength=n)),
                    pa.array(np.bincount(t.text, weights=token, minlength=n)),
                    words,
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>"
    part = cut(map_arrow(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("tf"))
    joined = rare.join(counts.select("word", "c"), "word")
    more = joined.groupBy("row").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("s"))
    n, s = F.coalesce("k", F.lit(0)), F.coalesce("s", F.lit(0.0))
    return part.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + n).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + s - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + s).alias("score"),
    )
