"""Quality by co-training: a view of the text and a view of the page's metadata teach each other.

Two logistic models start from the labelled rows. In each round, each model labels the rows without label of which it is
surest, positive and negative, out of the whole table, and the other model learns from them too. At the end each view is calibrated on labelled rows
kept aside for that, and all documents are scored by the two calibrated views together, weighted by how well each ranks those rows.

Labelled rows are a bounded sample, the ``LABELLED`` ones with the least hash of their id; every other row may be picked. Features of all rows are computed
once, in Arrow batches, and written; a round reads them, every task keeps its ``PER_ROUND`` surest texts by model and label, and these are
merged over two levels. Each label column gets a classifier of its own: ``quality`` (wanted) and ``toxic`` (not wanted).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, give_back, keep_rows, map_arrow, prepare, store

LABELLED = 12_000
#: Words that tell the labels apart in the labelled sample, so many a label; a word counts from so many rows on.
WORDS, LEAST_ROWS = 256, 5
ROUNDS, PER_ROUND, SURE = 3, 300, 0.97
META = 64
THRESHOLD = 0.5
#: Bytes in each class whose share is a feature.
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" \t", b"\n\r", b".,;:", b"!?", b"#*$%&|<>", b"\"'()[]{}-", range(0x80, 0x100)), 1):
    _CLASS[list(_chars)] = _k
STATS = 11 + 5


def text_stats(data: bytes) -> np.ndarray:
    """Dense features of a text: shares of byte classes, and shapes of words and lines."""
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    shares = np.bincount(_CLASS[raw], minlength=11) / n
    words = data.split()
    lines = data.split(b"\n")
    distinct = len(set(words)) / max(1, len(words))
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    return np.concatenate((np.sqrt(shares), (np.log1p(len(words)) / 10, len(raw) / n / max(1, len(words)) * min(n, 1000) / 10, distinct, repeated, np.log1p(len(lines)) / 10)))


def text_parts(texts: list[bytes], words: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
    """The features of some texts in short: their dense ones (32-bit floats), and the numbers of the telling words they have (16-bit integers)."""
    stats = [text_stats(data).astype("<f4").tobytes() for data in texts]
    found = [np.array(sorted(words[w] for w in set(data.lower().split()).intersection(words)), "<i2").tobytes() for data in texts]
    return stats, found


def text_view(stats: list[bytes], found: list[bytes], n_words: int) -> np.ndarray:
    out = np.zeros((len(stats), STATS + n_words), np.float32)
    out[:, :STATS] = np.frombuffer(b"".join(stats), "<f4").reshape(-1, STATS)
    rows = np.repeat(np.arange(len(found)), np.array([len(f) // 2 for f in found], np.int64))
    out[rows, STATS + np.frombuffer(b"".join(found), "<i2")] = 1
    return out


def meta_parts(lang: list, source: list, sizes: list[int]) -> list[bytes]:
    """The features of a row's metadata in short: its language and source, hashed, and the band of its length."""
    return [bytes((zlib.crc32(f"lang={a}".encode()) % 16, 16 + zlib.crc32(f"source={b}".encode()) % 32, 48 + min(15, int(np.log2(n + 1))))) for a, b, n in zip(lang, source, sizes, strict=True)]


def meta_view(parts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(parts), META), np.float32)
    out[np.repeat(np.arange(len(parts)), 3), np.frombuffer(b"".join(parts), np.uint8)] = 1
    return out


class Logistic:
    def __init__(self, width: int):
        self.w, self.b, self.mean, self.scale = np.zeros(width), 0.0, np.zeros(width), np.ones(width)
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 25, decay: float = 1e-3) -> None:
        """Newton's method, with halved steps where one goes too far, on standardised features; both labels weigh the same."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        z = np.ones((len(x), x.shape[1] + 1))
        z[:, :-1] = (x - self.mean) / self.scale
        weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
        penalty = np.append(np.full(x.shape[1], decay), 1e-9)
        loss = lambda w, s: float(weight @ (np.logaddexp(0, s) - y * s) + penalty @ (w * w) / 2)
        w, s = np.zeros(z.shape[1]), np.zeros(len(z))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            g = ((p - y) * weight) @ z + penalty * w
            root = z * np.sqrt(weight * p * (1 - p))[:, None]
            move = np.linalg.solve(root.T @ root + np.diag(penalty), g)
            gain, now, part = float(g @ move), loss(w, s), 1.0
            shift = z @ move
            while loss(w - part * move, s - part * shift) > now - 1e-4 * part * gain and part > 1e-3:
                part /= 2
            w, s = w - part * move, s - part * shift
            if gain < 1e-8:
                break
        self.w, self.b = w[:-1], float(w[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> float:
        """Fits slope and shift on rows not learnt from; returns how well the view ranks them (area under the curve)."""
        s = self.logit(x)
        a, c = 1.0, 0.0
        for _ in range(steps):
            g = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30))) - y
            a, c = a - 0.05 * float((g * s).mean()) , c - 0.2 * float(g.mean())
        self.slope, self.shift = max(a, 0.05), c
        rank = np.argsort(np.argsort(s)) + 1
        pos, neg = int(y.sum()), int((~y).sum())
        return float((rank[y].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else 0.5

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


class CoTrained:
    """Two views of one label."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views = [Logistic(text.shape[1]), Logistic(meta.shape[1])]
        self.weights, self.constant = np.array([1.0, 0.0]), None
        self.own, self.y, self.aside = [text, meta], y, np.arange(len(y)) % 5 == 4
        self.taught: list[dict[int, tuple[np.ndarray, bool]]] = [{}, {}]
        if len(np.unique(y)) < 2:  # one label only: nothing to tell apart
            self.constant = float(y[0]) if len(y) else 1.0
        self.train()

    def train(self) -> None:
        if self.constant is not None:
            return
        for own, view, taught in zip(self.own, self.views, self.taught, strict=True):
            more = np.array([x for x, _ in taught.values()]).reshape(len(taught), own.shape[1])
            view.fit(np.vstack((own[~self.aside], more)), np.concatenate((self.y[~self.aside], np.array([label for _, label in taught.values()], bool))))

    def teach(self, teacher: int, key: int, views: tuple[np.ndarray, np.ndarray], label: bool) -> None:
        """One view's label for a row, given to the other view; what a view was told first holds."""
        self.taught[1 - teacher].setdefault(key, (views[1 - teacher], label))

    def finish(self) -> None:
        """Calibrates both views; what only training needs is let go."""
        if self.constant is None:
            areas = np.array([view.calibrate(own[self.aside], self.y[self.aside]) for own, view in zip(self.own, self.views, strict=True)])
            gain = np.maximum(areas - 0.5, 0) ** 2
            self.weights = gain / gain.sum() if gain.sum() else self.weights
        del self.own, self.y, self.aside, self.taught

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text), self.constant)
        z = sum(w * v.calibrated(x) for w, v, x in zip(self.weights, self.views, (text, meta), strict=True))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling_words(rows: DataFrame, label: str) -> list[bytes]:
    """The words that most tell a label's values apart, by the difference of their shares of rows over its spread."""
    n = {r[label]: r.n for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return []

    def run(batch: pa.RecordBatch):
        words, labels = [], []
        for data, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            own = set(data.lower().split())
            words += own
            labels += [y] * len(own)
        yield pa.record_batch([pa.array(words, pa.binary()), pa.array(labels, pa.bool_())], ["word", "y"])

    counted = map_arrow(rows.select("text", F.col(label)), run, "word binary, y boolean").groupBy("word").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q"))
    a, b = F.col("p") / n.get(True, 1), F.col("q") / n.get(False, 1)
    spread = F.sqrt((a + b) / 2 * (1 / n.get(True, 1) + 1 / n.get(False, 1)) + 1e-12)
    best = counted.where(F.col("p") + F.col("q") >= LEAST_ROWS).orderBy(F.desc(F.abs(a - b) / spread), "word").limit(WORDS)
    return [bytes(r.word) for r in best.select("word").collect()]


META_COLUMNS = ("lang", "source")


def _rows(docs: DataFrame) -> DataFrame:
    kept = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in META_COLUMNS}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(n) for n, c in kept.items()])


class Classifier:
    """Fitted classifiers by label, with the words of the text view; small, and sent to every task."""

    def __init__(self, words: dict[bytes, int], models: dict[str, CoTrained]):
        self.words, self.models = words, models

    def scores(self, texts: list[bytes], lang: list, source: list) -> dict[str, np.ndarray]:
        text, meta = text_view(*text_parts(texts, self.words), len(self.words)), meta_view(meta_parts(lang, source, list(map(len, texts))))
        return {k: m.score(text, meta) for k, m in self.models.items()}


PARTS = "h long, stats binary, found binary, meta binary"


def _sure(features: DataFrame, models: dict[str, CoTrained], n_words: int) -> DataFrame:
    """label, view, positive and the features of the ``PER_ROUND`` texts of which each view is surest, for either value of each label. Copies of a text count once."""
    tasks = [(name, v, sign) for name, m in models.items() if m.constant is None for v in (0, 1) for sign in (1, -1)]
    shared = features.sparkSession.sparkContext.broadcast(([[(w.w, w.b, w.mean, w.scale) for w in m.views] for m in models.values() if m.constant is None]))  # of a fixed size
    least = np.log(SURE / (1 - SURE))

    def run(batches):
        best: list[dict[int, tuple]] = [{} for _ in tasks]  # by text: how sure, and its features
        for batch in batches:
            stats, found, meta = (batch.column(c).to_pylist() for c in ("stats", "found", "meta"))
            keys = batch.column("h").to_pylist()
            rows = (text_view(stats, found, n_words), meta_view(meta))
            for k, (_, v, sign) in enumerate(tasks):
                w, b, mean, scale = shared.value[k // 4][v]
                z = sign * np.round(((rows[v] - mean) / scale) @ w + b, 6)  # the last bits depend on how rows are batched
                own = best[k]
                for j in np.flatnonzero(z > least).tolist():
                    new = (float(z[j]), meta[j], stats[j], found[j])
                    if keys[j] not in own or own[keys[j]] < new:
                        own[keys[j]] = new
                if len(own) > PER_ROUND:
                    best[k] = dict(sorted(own.items(), key=lambda x: (-x[1][0], x[0]))[:PER_ROUND])
        for k, own in enumerate(best):
            if own:
                z, meta, stats, found = zip(*own.values(), strict=True)
                yield pa.record_batch([pa.array([k] * len(own), pa.int32()), pa.array(z), *(pa.array(c, t) for c, t in zip((list(own), stats, found, meta), (pa.int64(), *[pa.binary()] * 3), strict=True))], ["task", "z", "h", "stats", "found", "meta"])
        give_back()

    each = features.mapInArrow(run, f"task int, z double, {PARTS}").groupBy("task", "h").agg(F.max(F.struct("z", "meta", "stats", "found")).alias("one")).select("task", "h", "one.*")
    for keys in (["task", F.pmod("h", F.lit(64))], ["task"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z"), "h"))
        each = each.withColumn("rank", rank).where(F.col("rank") <= PER_ROUND).drop("rank")
    named = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(v).alias("view"), F.lit(s > 0).alias("positive")) for n, v, s in tasks])
    return each.select(F.element_at(named, F.col("task") + 1).alias("t"), "h", "stats", "found", "meta").select("t.*", "h", "stats", "found", "meta")


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "toxic")) -> Classifier:
    """Fits on documents that have labels (doc_id and a 0/1 column for each name). Rows with a null label or id are no labelled ones; where
    rows of one id differ, the smaller quality and the larger other labels hold. Null texts are empty ones, null metadata a value of their own; without labelled
    rows every score is 1."""
    prepare(docs.sparkSession)
    rows = _rows(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(n).cast("int").alias(n) for n in names]).dropna()
    known = known.groupBy("doc_id").agg(*[(F.min(n) if n == "quality" else F.max(n)).alias(n) for n in names])
    some = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    # the side to be broadcast has a fixed number of rows of numbers; without that, all texts would be shuffled to find the sample
    sample = cut(rows.join(F.broadcast(some), "doc_id").select("text", *META_COLUMNS, "doc_id", *[(F.col(n) > 0).alias(n) for n in names]))
    words: dict[bytes, int] = {}
    for n in names:
        for w in _telling_words(sample, n):
            words.setdefault(w, len(words))

    def features(batch: pa.RecordBatch):
        texts = as_bytes(batch.column(0))
        stats, found = text_parts(texts, words)
        meta = meta_parts(batch.column(1).to_pylist(), batch.column(2).to_pylist(), list(map(len, texts)))
        columns = [pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64()), *(pa.array(c, pa.binary()) for c in (stats, found, meta))]
        yield pa.record_batch([*columns, *batch.columns[3:]], ["h", "stats", "found", "meta", *batch.schema.names[3:]])

    flags = "".join(f", {n} boolean" for n in names)
    own = map_arrow(sample.drop("doc_id"), features, PARTS + flags).orderBy("h", "meta", *names).toArrow()  # the bounded sample
    views = lambda t: (text_view(t["stats"].to_pylist(), t["found"].to_pylist(), len(words)), meta_view(t["meta"].to_pylist()))
    models = {n: CoTrained(*views(own), np.array(own[n].to_pylist(), bool)) for n in names}
    if any(m.constant is None for m in models.values()):
        other = rows.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("text", *META_COLUMNS)
        pool = store(map_arrow(other, features, PARTS), "features")
        for _ in range(ROUNDS):
            sure = _sure(pool, models, len(words)).orderBy("label", "view", "positive", "h").toArrow()  # PER_ROUND rows a model and value at most
            text, meta = views(sure)
            for k, row in enumerate(sure.select(["label", "view", "positive", "h"]).to_pylist()):
                models[row["label"]].teach(row["view"], row["h"], (text[k], meta[k]), row["positive"])
            for m in models.values():
                m.train()
    for m in models.values():
        m.finish()
    return Classifier(words, models)


def _verdict(found: dict[str, np.ndarray]) -> np.ndarray:
    good = np.ones(len(next(iter(found.values()))), bool)
    for name, p in found.items():
        good &= p >= THRESHOLD if name == "quality" else p < THRESHOLD
    return good


def classify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, a score for each label, and kept, of every row. A null text is the empty text, null metadata a value of their own. Repeated rows each
    give their row, a null doc_id stays null, an empty table gives no rows; other columns take no part."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # of a fixed size

    def run(batch: pa.RecordBatch):
        found = shared.value.scores(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
        yield pa.record_batch([batch.column(0), *(pa.array(p) for p in found.values()), pa.array(_verdict(found))], ["doc_id", *(f"{n}_score" for n in found), "kept"])

    return map_arrow(_rows(docs), run, "doc_id long" + "".join(f", {n}_score double" for n in classifier.models) + ", kept boolean")


def keep(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are. A null text is the empty text, null or lacking metadata a value of their own; repeated rows stay or go
    together, an empty table gives no rows."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # of a fixed size
    as_list = lambda c: c.cast(pa.string()).to_pylist()
    return keep_rows(docs, ["text", *META_COLUMNS], lambda texts, lang, source: _verdict(shared.value.scores(as_bytes(texts), as_list(lang), as_list(source))))
