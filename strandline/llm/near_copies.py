"""Near-duplicates by SimHash, verified by the Jaccard similarity of shingle sets.

Candidates are 64-bit SimHashes that pigeonhole blocks link, as in ``simhash``. Similarity 0.8 can mean more differing bits than blocks can
find; the rest is found by shared prefixes: a set's shingles are ordered by hash, those of passages that many texts share after all others, and two sets of similarity t at least
share one among the first ``n - ceil(t n) + 1`` of each. Inside a group of those, pairs that size and place still allow and whose 128-bit SimHashes are
near are candidates. Each task gives stars, not all pairs. Components of candidates hold every similar pair; each is split by exact
similarity, in parts that meet pairwise where it is large.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_bytes, attach, hot_keys, keyed, map_arrow, pick, prepare, salted, squeeze, store, unsqueeze
from .components import components, stars
from .rolling import Levels, mix
from .spans import symbols

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: Differing bits, of 128, up to which a pair is a candidate. Similarity 0.8 means about 20.
RADIUS = 44
#: Sets of one group that one task compares at once.
GROUP = 4096
#: Shingles of a component of candidates that one task gets; parts of larger ones meet pairwise.
PART = 1 << 20
#: Links that a task holds before it gives them on.
LINKS = 1 << 19
#: Shingles that many texts share come last in the order that prefixes follow: the ``COMMON`` most frequent of those that stand in ``GROUP / 2`` texts or
#: more, by the share 1 / ``SAMPLE`` of distinct texts. Any one order loses no pair, so the sample only decides how small groups are.
COMMON, SAMPLE = 1 << 16, 16
SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of one UTF-8 text, in order; of all its words, if they are fewer than a shingle has."""
    if not data.strip():
        return np.zeros(0, np.uint64)
    values, _ = symbols(data.lower(), words=True)
    return np.unique(Levels(values).all(min(shingle, len(values)))) if len(values) else np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as two signed longs."""
    out = []
    for hashes in (found, mix(found ^ SALT)):
        ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])
    return np.array(out)


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that very many texts share, ``COMMON`` at most, in order."""
    some = squeeze(rows.where(F.pmod("tag", F.lit(SAMPLE)) == 0).select("tag", "text"), once=("tag",)).dropDuplicates(["tag"])

    def run(batch: pa.RecordBatch):
        found, n = np.unique(np.concatenate([shingles(x or b"", shingle) for x in unsqueeze(batch)]), return_counts=True)
        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = map_arrow(some, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, GROUP // (2 * SAMPLE)))
    return np.sort(counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def _sets(rows: DataFrame, shingle: int, t: Fraction, common: np.ndarray | None = None) -> DataFrame:
    """id, tag, and of the set: node (its hash), size, sketch, and the prefix of its hashes, those in ``common`` coming after all others."""
    shared = rows.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if common is None else common)  # of a bounded size

    def ordered(found: np.ndarray) -> np.ndarray:
        if not len(shared.value):
            return found
        late = shared.value[np.minimum(np.searchsorted(shared.value, found), len(shared.value) - 1)] == found
        return np.concatenate((found[~late], found[late]))

    def run(batch: pa.RecordBatch):
        out: list[list] = [[], [], [], [], []]
        for data in as_bytes(batch.column(3)):
            found = shingles(data, shingle)
            n = len(found)
            a, b = sketch(found)
            prefix = ordered(found)[: n - -(-t.numerator * n // t.denominator) + 1] if n else found
            for column, x in zip(out, (xxhash.xxh64_intdigest(found.tobytes()), n, a, b, prefix.tobytes()), strict=True):
                column.append(x)
        columns = [pa.array(np.array(out[0], np.uint64).view(np.int64)), *(pa.array(c, k) for c, k in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))]
        yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["id", "tag", "node", "size", "s1", "s2", "prefix"])

    return map_arrow(rows, run, "id long, tag long, node long, size int, s1 long, s2 long, prefix binary")


def _posted(nodes: DataFrame) -> DataFrame:
    """A row per shingle of each prefix, with its place."""

    def run(batch: pa.RecordBatch):
        prefixes = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        length = np.array([len(p) for p in prefixes])
        if not length.sum():
            return
        own = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), length) for c in ("size", "s1", "s2")]
        place = np.concatenate([np.arange(n) for n in length]).astype(np.int32)
        columns = (np.concatenate(prefixes), own[0], place, own[1], own[2])
        for k in range(0, len(place), 20_000):
            yield pa.record_batch([pa.array(c[k : k + 20_000]) for c in columns], ["key", "size", "place", "s1", "s2"])

    return map_arrow(nodes, run, "key long, size int, place int, s1 long, s2 long")


def _candidates(columns: list[np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links between first SimHashes, inside groups of equal key, that with those of blocks connect all candidate pairs of each; columns as of
    ``_posted``, in order of key."""
    keys, s1, s2 = columns[0], columns[3], columns[4]
    size = columns[1].astype(np.int64)
    left = size - columns[2]

    def near(i, j):
        # at the first shingle that two sets share, what is left bounds their overlap
        can = np.minimum(left[i], left[j]) * (t.numerator + t.denominator) >= t.numerator * (size[i] + size[j])
        return can & (np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64)) + np.bitwise_count((s2[i] ^ s2[j]).view(np.uint64)) <= RADIUS)

    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(first, len(keys)))
    sizes = np.repeat(length, length)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, 16):
        same = np.flatnonzero((keys[step:] == keys[:-step]) & (sizes[step:] <= 16))
        if not len(same):
            break
        same = same[near(same, same + step)]
        a.append(s1[same])
        b.append(s1[same + step])
    for at, n in zip(first[length > 16].tolist(), length[length > 16].tolist(), strict=True):
        rest = np.arange(at, at + n)
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                hit = near(np.full(len(rest), x), rest)
                found, rest = rest[hit], rest[~hit]
                a.append(np.full(len(found), s1[x]))
                b.append(s1[found])
                queue += found.tolist()
    a, b = np.concatenate(a), np.concatenate(b)
    beyond = np.bitwise_count((a ^ b).view(np.uint64)) > simhash.RADIUS  # blocks link the others
    return a[beyond], b[beyond]


def _in_stars(batches):
    """The links of a task (a, b) as stars: a large group's links are the same for most of its keys, and so few in all."""
    held, n = [], 0

    def joined():
        return stars(*(np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1)))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > LINKS:
            held = [joined()]
            n = len(held[0][0])
            if 2 * n > LINKS:
                yield pa.record_batch([pa.array(c) for c in held[0]], ["a", "b"])
                held, n = [], 0
    yield pa.record_batch([pa.array(c) for c in joined()], ["a", "b"])


def _by_group(sorted_: DataFrame, function, schema: str, after=None) -> DataFrame:
    """``function`` over whole groups of rows that have the same first column and stand together; ``after`` over all that a task yields."""

    def groups(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = held.column(0).to_numpy()
            at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if at:
                yield from function(held.slice(0, at))
                held = held.slice(at)
        if held is not None:
            yield from function(held)

    return sorted_.mapInArrow(groups if after is None else lambda batches: after(groups(batches)), schema)


def _meetings(chunk, chunks):
    """The numbers of the pairs of chunks that a row of ``chunk``, of so many, takes part in: each two chunks meet, a single one is by itself."""
    others = F.filter(F.sequence(F.lit(0), chunks - 1), lambda o: (o != chunk) | (chunks == 1))
    return F.transform(others, lambda o: F.least(o, chunk) * 1_000_003 + F.greatest(o, chunk))


def beyond(nodes: DataFrame, t: Fraction = SIMILARITY) -> DataFrame:
    """(a, b): candidate links between first SimHashes (s1) of ``nodes`` that blocks don't find, by shared prefixes."""
    rows = _posted(nodes)
    large = rows.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("s1", "s2", "size", F.lit(7)), F.col("chunks")).cast("int")
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("chunk", F.coalesce(own, F.lit(0)))
    rest = ["size", "place", "s1", "s2"]
    rows = rows.select("key", *rest, F.explode(_meetings(F.col("chunk"), F.coalesce("chunks", F.lit(1)))).alias("pair"))
    rows = rows.select(F.xxhash64("key", "pair").alias("key"), *rest)

    def found(table: pa.Table):
        a, b = _candidates([c.to_numpy() for c in table.columns], t)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    # in order of s1, so that a group's star has the same middle under most keys
    return _by_group(rows.repartition("key").sortWithinPartitions("key", "s1"), found, "a long, b long", _in_stars).distinct()


def links(nodes: DataFrame, t: Fraction = SIMILARITY) -> DataFrame:
    """(a, b): links between first SimHashes (s1) of ``nodes`` that connect all candidates: by pigeonhole blocks, and by prefixes the rest."""
    fps = store(nodes.select(F.col("s1").alias("fp")).distinct(), "fps")
    blocks = store(simhash.links(fps, fps.count()).toDF("a", "b"), "blocks")
    return blocks.unionByName(store(beyond(nodes, t), "beyond"))


def _members(nodes: DataFrame, t: Fraction) -> DataFrame:
    """id, tag, node, root, parts and part of each node in a component of candidates that has others."""
    owner = components(links(nodes, t)).select(F.col("node").alias("s1"), "root")
    rows = nodes.select("s1", "node", "size", "one.*")
    rows = salted(rows, owner, ["s1"], hot_keys(rows, ["s1"]), "left").withColumn("root", F.coalesce("root", "s1"))
    rows = store(rows, "rooted")
    parts = F.ceil(F.sum("size") / PART).cast("int").alias("parts")
    roots = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), parts).where("n > 1")
    return attach(rows, roots, ["root"], "n").select("id", "tag", "node", "root", "parts", F.pmod(F.xxhash64("node", F.lit(7)), "parts").cast("int").alias("part"))


def _verified(docs: DataFrame, members: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """(parts, node, head): the links of exact similarity t that connect the nodes of each component, as stars inside each task's sets. Where a component
    has one part, head is one for each class."""

    def again(batch: pa.RecordBatch):
        found = [shingles(x or b"", shingle).tobytes() for x in unsqueeze(batch)]
        yield pa.record_batch([*(batch.column(c) for c in ("root", "node", "parts", "part")), pa.array(found, pa.binary())], ["root", "node", "parts", "part", "found"])

    texts = squeeze(keyed(docs).select("id", "tag", "text"), once=("id", "tag")).join(members, ["id", "tag"]).dropDuplicates(["id", "tag"])
    sets = map_arrow(texts, again, "root long, node long, parts int, part int, found binary")
    sets = sets.withColumn("pair", F.explode(_meetings(F.col("part"), F.col("parts")))).select(F.xxhash64("root", "pair").alias("key"), "parts", "node", "found")

    def split(table: pa.Table):
        keys, parts, nodes, found = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3)
        edges = np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, at = np.unique(nodes[a:b], return_index=True)
            head = own[similar([np.frombuffer(found[a + k].as_py(), np.uint64) for k in at.tolist()], t)]
            yield pa.record_batch([pa.array(parts[a:b][at]), pa.array(own), pa.array(head)], ["parts", "node", "head"])

    return _by_group(sets.repartition("key").sortWithinPartitions("key"), split, "parts int, node long, head long")


def similar(sets: list[np.ndarray], t: Fraction = SIMILARITY) -> np.ndarray:
    """For each set, the index of the first one that links of similarity t at least reach."""
    n, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(code, np.cumsum(size)[:-1])
    head, open_ = np.arange(n), np.ones(n, bool)
    left, indexed = n, 2 * n + 2
    for s in range(n):
        if not open_[s]:
            continue
        open_[s] = False
        left -= 1
        queue = [s]
        while queue and left:
            if 2 * left < indexed:  # postings of the sets not yet reached
                some = open_[owner]
                order = np.argsort(code[some], kind="stable")
                posted = owner[some][order]
                at = np.searchsorted(code[some][order], np.arange(code.max() + 2))
                indexed = left
            x = queue.pop()
            start, count = at[own[x]], at[own[x] + 1] - at[own[x]]
            places = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(posted[places], minlength=n)
            hit = np.flatnonzero(open_ & (shared * (t.numerator + t.denominator) >= t.numerator * (size + size[x])))
            head[hit], open_[hit] = s, False
            left -= len(hit)
            queue += hit.tolist()
    return head


def keep_one(docs: DataFrame, shingle: int = SHINGLE, t: Fraction = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group that links of Jaccard similarity t at least connect: that of the smallest doc_id, a null one being
    larger than any. Rows that repeat a doc_id, or have none, are grouped by their texts like others. Texts without words are one group. Columns as they are."""
    prepare(docs.sparkSession)
    rows = keyed(docs)
    sets = _sets(rows, shingle, t, _common(rows, shingle)).groupBy("node")
    nodes = store(sets.agg(F.min(F.struct("id", "tag")).alias("one"), *(F.first(c).alias(c) for c in ("size", "s1", "s2", "prefix"))), "nodes")
    members = store(_members(nodes.where("size > 0"), t), "members")
    verified = store(_verified(docs, members, shingle, t), "verified")
    large = components(verified.where("parts > 1").select(F.col("node").alias("a"), F.col("head").alias("b")))
    heads = verified.where("parts = 1").select("node", "head").union(large)
    chosen = nodes.select("node", "one").join(heads, "node", "left").groupBy(F.coalesce("head", "node").alias("head")).agg(F.min("one").alias("one"))
    return pick(docs, chosen.select("one.*"))
