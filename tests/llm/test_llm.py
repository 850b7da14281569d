"""The operators for training corpora against brute force, round trips and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import bpe, components, maxent, near_copies, packing, permutation_index, quality_classifier, quality_rules, reply_trees, simhash, spans, substring_dedup, suffix_dedup
from strandline.llm.merging import MergeTable
from strandline.llm.queries import vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(n, seed, size=40):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def rows():
    shared, other = words(80, 1, 1000), words(120, 2, 1000)
    return [
        (0, words(200, 3, 1000) + " " + shared + " " + words(50, 4, 1000)),
        (1, "x y " + shared + " z"),
        (2, None),
        (3, ""),
        (4, other),
        (5, other),
        (5, other + " a  b\n\nç é"),
        (6, other + " " + other),
        (None, shared),
        (7, "Ünïcode 漢字 <|endoftext|> don't   \n  12345 \x1c x y"),
        (8, "a" * 30_000 + " " + "ab" * 900),
        (9, "one two three"),
        (10, words(60_000, 5, 3000)),
        (11, "same line\nsame line\nsame line\n" * 9),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, id long, tag int, fp string, component_id int, core double"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4.0) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def multiset(found):
    return collections.Counter(tuple(r) for r in found)


def test_bpe(docs, none, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert multiset(bpe.round_trip(docs, path).collect()) == collections.Counter(want)
    assert bpe.round_trip(none, path).count() == 0
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert multiset(back.select("doc_id", "text").collect()) == collections.Counter((d, t or "") for d, t in rows)


def test_lookahead():
    # a, b, then ab + c only where c follows: the chain's left and right parts add up
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"c", b"ab")]) >= 2
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c")])


def test_streaming_equals_whole():
    b = bpe.ByteBPE.load(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    for _ in range(5):
        data = bytes(rng.choice(list(b"thengiosaer"), 4000).tolist())
        assert list(b.stream(data)) == b.merge(data)


def test_merge_runs():
    t = MergeTable([(1, 1, 2), (2, 2, 3)])
    got, sizes = t.merge(np.array([1] * 7 + [1, 5]), np.array([7, 2]))
    assert got.tolist() == [3, 2, 1, 1, 5] and sizes.tolist() == [3, 2]


def brute_simhash(text):
    w = WORD.findall((text or "").encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def test_simhash(docs, none, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_simhash(t) for _, t in rows]
    order = [d if d is not None else math.inf for d, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    root[j] = root[i] = min(root[i], root[j])
    least = [min(o for o, r in zip(order, root, strict=True) if r == mine) for mine in root]
    want = collections.Counter((d, f"{f:016x}", None if c == math.inf else c) for (d, _), f, c in zip(rows, fps, least, strict=True))
    assert multiset(r[:3] for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_without_ids(spark):
    texts = [words(100, 40 + k, 1000) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (7, texts[4]), (None, texts[4]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4])}
    got = [tuple(r) for r in simhash.keep_one(df, shingle=5).collect()]
    assert len(got) == 6 and set(got) - {(None, None), (None, "")} == want


def test_pipeline_near_duplicates(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = [None, "", " \n", "one two", "One  TWO", "one three"]
    for n in (6, 12, 60, 300):
        for _ in range(12):
            base = [f"w{k}" for k in rng.integers(0, 3000, n)]
            for changes in range(7):
                some = list(base)
                for at in rng.integers(0, n, changes * max(1, n // 150)):
                    some[at] = f"v{rng.integers(3000)}"
                texts.append(" ".join(some[: n - int(rng.integers(0, 1 + n // 20))]))
    common = words(30, 77, 1000)
    texts += [common + " " + words(int(rng.integers(2, 60)), 500 + k, 1000) for k in range(60)]
    ids = [None if k % 11 == 3 else k for k in rng.permutation(len(texts)).tolist()]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    groups = collections.defaultdict(list)
    for r, d in zip(root, ids, strict=True):
        groups[r].append(math.inf if d is None else d)
    want = collections.Counter(None if min(g) == math.inf else min(g) for g in groups.values())
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    stage = lambda: collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert stage() == want and len(want) < len(texts) - 50
    monkeypatch.setattr(near_copies, "GROUP", 20)
    assert stage() == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def near_group(n: int, length: int, seed: int) -> list[str]:
    """Texts made of one by changing each a word or two."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        some = list(base)
        for at in rng.integers(0, length, 2):
            some[at] = f"v{rng.integers(10**6)}"
        out.append(" ".join(some))
    return out


def test_near_copies_of_large_components(spark, monkeypatch):
    """A component of more shingles than a task gets is split in parts, which give the same classes."""
    texts = near_group(90, 70, 1) + near_group(40, 70, 2) + ["alone " + words(60, k, 900) for k in range(5)]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(k for k, r in enumerate(root) if r == mine) for mine in root}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "PART", 1000)
    nodes = near_copies._sets(near_copies.keyed(docs), 5, near_copies.SIMILARITY).withColumn("one", F.struct("id", "tag"))
    parts = near_copies._members(nodes, near_copies.SIMILARITY).groupBy("root", "part").count().collect()
    assert len(parts) > len({p.root for p in parts}) and max(p["count"] for p in parts) * 66 < 3000
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def test_near_copies_by_blocks(spark, monkeypatch):
    """Pairs of 4 differing bits at most are found by pigeonhole blocks, and prefixes add only pairs of more."""
    texts = near_group(60, 400, 3)
    fps = [int(near_copies.sketch(near_copies.shingles(t.encode()))[0]) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    four, five, zero = (np.array([0, k], np.int64) for k in (15, 31, 0))
    key, size = np.array([9, 9]), np.array([50, 50], np.int32)
    assert len(near_copies._candidates([key, size, zero, four, zero], near_copies.SIMILARITY)[0]) == 0
    assert [c.tolist() for c in near_copies._candidates([key, size, zero, five, zero], near_copies.SIMILARITY)] == [[0], [31]]
    root = list(range(len(texts)))
    for i, a in enumerate(fps):
        for j in range(i):
            if ((a ^ fps[j]) & (2**64 - 1)).bit_count() <= 4 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(k for k, r in enumerate(root) if r == mine) for mine in root}
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "beyond", lambda nodes, t: none)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want and len(want) < 50


def test_links_of_near_copies_are_few(spark):
    """A group of near copies gives stars with one middle, not one for each shared shingle; a node's links don't meet in one task."""
    texts = near_group(300, 70, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = near_copies._sets(near_copies.keyed(docs), 5, near_copies.SIMILARITY)
    n = near_copies.links(nodes).count()
    assert n < 1.8 * len(texts), n
    star = spark.createDataFrame([(0, k) for k in range(1, 3001)], "a long, b long")
    least = star.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = components._met(star, least, 3000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in met) == 3000 and max(r["count"] for r in met) < 2000
    assert components.components(star).where("root = 0").count() == 3000


def test_shared_passages_make_no_large_groups(spark, monkeypatch):
    """Texts that share a passage only don't meet under its shingles, so no group of theirs grows with the table."""
    passage = words(40, 70, 10**6)
    texts = [f"{words(160, 100 + k, 10**6)} {passage}" for k in range(300)]
    texts += [texts[7] + " one more", "gone " + texts[8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    posted, largest = near_copies._posted, []

    def counted(nodes):
        largest.append(posted(nodes).groupBy("key").count().agg(F.max("count")).first()[0])
        return posted(nodes)

    monkeypatch.setattr(near_copies, "_posted", counted)
    monkeypatch.setattr(near_copies, "GROUP", 64)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(range(300))
    assert max(largest) < 64, largest


def test_few_links_need_few_jobs(spark, monkeypatch):
    """Components of a bounded number of links are settled in one task; rounds, which larger graphs take, agree with it."""
    rng = np.random.default_rng(5)
    pairs = [(k, k + 1) for k in range(6)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 90, (40, 2))] + [(-5, 3000), (3000, -(2**62))]
    links = spark.createDataFrame(pairs, "a long, b long")

    def run():
        spark.sparkContext.setJobGroup(group := f"components-{rng.integers(10**9)}", "")
        found = collections.Counter((r.node, r.root) for r in components.components(links).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, jobs

    few, jobs = run()
    assert jobs <= 12, jobs
    monkeypatch.setattr(components, "FEW", 0)
    many, more = run()
    assert few == many and jobs < more and few[6, 0] == 1 and few[3000, -(2**62)] == 1


def test_links_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 50)
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = list({base ^ sum(1 << int(b) for b in rng.integers(0, 62, 3)) for _ in range(400)} | {int(x) for x in rng.integers(1 << 62, size=200)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(df, len(fps)).collect()
    assert all((r.x ^ r.y).bit_count() <= 4 for r in found) and len(found) < 20_000
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(r.x, r.y) for r in found], "a long, b long")).collect()}
    labels = {f: f for f in fps}
    for _ in range(20):
        for f in fps:
            near = [labels[g] for g in fps if (f ^ g).bit_count() <= 4]
            labels[f] = min(near)
    assert {f: got.get(f, f) for f in fps} == labels


def test_components_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(links).collect()} == {0}


def gone(n, starts, width):
    out = np.zeros(n + 1, int)
    for i in starts:
        out[i] += 1
        out[i + width] -= 1
    return np.cumsum(out)[:-1] > 0


def test_suffix_dedup(docs, none, rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = []
    for (d, _), b in zip(rows, data, strict=True):
        m = gone(len(b), [i for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1], 400)
        want.append((d, len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    assert multiset(suffix_dedup.remove_repeats(docs).collect()) == collections.Counter(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_substring_dedup(docs, none, rows):
    w = [WORD.findall((t or "").encode()) for _, t in rows]
    order = [d if d is not None else math.inf for d, _ in rows]
    first = {}
    for o, x in zip(order, w, strict=True):
        for i in range(len(x) - 49):
            k = tuple(x[i : i + 50])
            first[k] = min(first.get(k, math.inf), o)
    want = []
    for (d, _), o, x in zip(rows, order, w, strict=True):
        m = gone(len(x), [i for i in range(len(x) - 49) if first[tuple(x[i : i + 50])] < o], 50)
        want.append((d, len(x), int(m.sum()), hashlib.sha256(b" ".join(y for y, g in zip(x, m, strict=True) if not g)).hexdigest()))
    assert multiset(substring_dedup.remove_repeats(docs).collect()) == collections.Counter(want)
    assert substring_dedup.remove_repeats(none).count() == 0


def brute_removed(rows, window=50):
    """Words removed of each of ``rows`` (doc_id, text), a null doc_id coming last."""
    least: dict = {}
    tokens = [(math.inf if d is None else d, t.split()) for d, t in rows]
    for d, w in tokens:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            least[x] = min(least.get(x, math.inf), d)
    return [sum(gone(len(w), [k for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < d], window)) for d, w in tokens]


def test_substring_dedup_body_twice(spark):
    rows = []
    for k in range(6):
        x, y, a, b, p = (words(n, 100 * k + j, 5000) for j, n in enumerate((60, 60, 70, 70, 90)))
        rows += [(2 * k, f"{x} {p} {y}"), (2 * k + 1, " ".join([a, p, b] * 2))]
    x, y, a, b, p = (words(n, 900 + j, 5000) for j, n in enumerate((60, 60, 70, 70, 90)))
    rows += [(50, f"{x} {p} {y}"), (None, f"{a} {p} {b}"), (None, f"{a} {p} {b} other")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_removed(rows)
    assert multiset((r.doc_id, r.n_words, r.n_removed) for r in got) == collections.Counter((d, len(t.split()), n) for (d, t), n in zip(rows, want, strict=True))
    assert want[1] == 180


def test_quality_rules(docs, none, rows):
    got = quality_rules.judge(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert by[9].base_failed and by[2].n_words == 0 and by[11].n_dup_lines == 26 and not by[11].kept and by[0].kept
    assert got.count() == len(rows) and quality_rules.judge(none).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[(d, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs, path).collect()
    assert multiset(r[:5] for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) == -(-sum(r.length for r in got) // 4096) and packing.pack(none, path).count() == 0


def test_packing_learns_each_pretoken_once(monkeypatch):
    """Words that differ by signs around them share what is learnt; ids stay those of the library."""
    path = vocabulary("word_bpe_49k.json")
    bpe = packing.WordBPE(path)
    bpe.encode_many([b"Strand strand, (strand) strand. strand's STRAND'S"])
    assert set(bpe.words) == {b"strand", b",", b"(", b")", b".", b"'s"}
    odd = [
        "don't 'tis we've they'll I'd 're 'r 'l 'll's ''s ,'s a'start x'vest 'm'd 's't '", "a1b22c3.5e-7 __init__ #!/bin/sh $%&* ...", "Straße ÉCOLE naïve¿ İstanbul ŉ Ⱥb ǅ ª² ½x",
        "e\u0301cole H\u0331x I\u0307 a\u00a0b c\u0085d e\u2028f g\x1ch \x00i \x7f j\u00adk", "шум 数据，处理 a数b العربية\u200f 😀:)", "z" * 300 + " " + "!" * 300 + " 'é'" + "7" * 40, "", " \t\r\n", "<|endoftext|> a <| b",
    ]
    rng = np.random.default_rng(5)
    odd += ["".join(rng.choice(list("abstmdrevl'' .,1É\u0301ſш\n\xa0"), 60)) for _ in range(300)]
    want = [np.array(bpe.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert bpe.encode_many([t.encode() for t in odd]) == want
    assert [bpe.encode_many([t.encode()])[0] for t in odd] == want
    monkeypatch.setattr(packing, "ENCODED", 16)
    assert [bpe.encode_many([t.encode()])[0] for t in odd] == want


def test_lower_bound():
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([34] * 9), 100) >= 4
    bins, _ = packing.best_fit(np.array([50, 50, 30, 70]), 100)
    assert len(set(bins.tolist())) == 2


def test_permutation_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:130] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [math.nan] + [1.0] * 23), (2060, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in permutation_index.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        s[q] = -math.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hits += len({r.vec_id for r in found} & set(best.tolist()))
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found) and [r.rank for r in found] == list(range(1, 21))
    assert hits / (20 * len(got)) >= 0.9
    twice = df.where("vec_id < 3").union(df.where("vec_id = 1")).withColumn("id", F.lit("x")).withColumn("files", F.lit(1))
    assert sorted(r.vec_id for r in permutation_index.search(twice, twice.where("vec_id = 0")).collect()) == [1, 1, 2]
    with pytest.raises(ValueError):
        permutation_index.search(df.select("vec_id", F.slice("embedding", 1, F.when(F.col("vec_id") == 7, 3).otherwise(24)).alias("embedding")), df)
    few = df.where("vec_id < 5 or vec_id > 1999")
    assert permutation_index.search(few, few.where("vec_id = 0")).count() == 4
    assert permutation_index.search(few.limit(0), few).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_permutation_index_recall(spread):
    """Full shards of isotropic vectors, the hardest kind, of one length and of varied ones; each query reads an eighth of the files."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(24_576, 64))
    x *= (rng.lognormal(0, spread, size=len(x)) / np.linalg.norm(x, axis=1))[:, None]
    longest = np.linalg.norm(x, axis=1).max()
    pivots = permutation_index.level(x[rng.choice(len(x), permutation_index.PIVOTS, replace=False)], longest)
    found, asked = collections.defaultdict(list), range(0, len(x), 400)
    for a in range(0, len(x), permutation_index.SHARD):
        shard = x[a : a + permutation_index.SHARD]
        files = permutation_index.post(permutation_index.nearest(permutation_index.level(shard, longest), pivots, permutation_index.PREFIX), len(pivots))
        take = int(np.ceil(permutation_index.SHARE * len(shard))) + permutation_index.MORE * 20
        for q in asked:
            order = permutation_index.nearest(np.append(x[q], 0.0)[None, :], pivots, permutation_index.PREFIX)[0]
            found[q] += (a + np.argsort(-permutation_index.closeness(order, files, len(shard)), kind="stable")[:take]).tolist()
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -math.inf
        hits += len(set(found[q]) & set(np.argsort(-s)[:20].tolist()))
        assert len(found[q]) <= 0.15 * len(x)
    assert hits / (20 * len(asked)) >= 0.9


def test_reply_trees(spark):
    text = "\\### Assistant: </turn> ok \\0 \\1 \\2 <#\n"
    nodes = [(1, "a", None, "user", text, 0), (1, "b", "a", "assistant", text, 5), (1, "c", "a", "assistant", "é漢", 9), (1, "d", "c", "us:er#", None, None), (None, "x", None, None, "", 1)]
    df = spark.createDataFrame(nodes, "tree long, node string, parent string, role string, text string, score long")
    got = {r.leaf: r for r in reply_trees.format_trees(df).withColumn("turns", reply_trees.read_back(F.col("formatted"))).collect()}
    assert got["d"].branch_rank == 1 and got["b"].branch_rank == 2 and got["x"].n_turns == 1
    assert [tuple(t) for t in got["b"].turns] == [("user", text), ("assistant", text)]
    assert [tuple(t) for t in got["d"].turns] == [("user", text), ("assistant", "é漢"), ("us:er#", "")]
    assert [got["d"].formatted[m.start : m.start + m.length] for m in got["d"].loss] == ["é漢"]
    assert reply_trees.format_trees(df, best=1).count() == 2 and reply_trees.format_trees(df.limit(0)).count() == 0


def test_reply_trees_cycle(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "MAX_ROUNDS", 3)
    df = spark.createDataFrame([(1, "a", "b", "user", "", 0), (1, "b", "a", "user", "", 0)], "tree long, node string, parent string, role string, text string, score long")
    with pytest.raises(RuntimeError):
        reply_trees.format_trees(df)


def test_maxent(docs, none, rows):
    tokens = [[*WORD.findall((t or "").encode().lower()), None] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in rows]
    c = collections.Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n = sum(c.values())
    want = sorted((str(d), h, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in t), 4)) for (d, _), h, t in zip(rows, held, tokens, strict=True))
    got = maxent.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and maxent.score(none).count() == 0


def test_maxent_sums_to_one():
    m = maxent.Model(np.arange(10, dtype=np.uint64), np.arange(100, 0, -10), np.zeros(10, np.int64), np.array([580.0] + [0] * 15), np.array([25.0] + [0] * 15))
    p = maxent.softmax_rows(m.weights, m.bias, np.zeros((3, 1), np.int64))
    assert abs(p.sum() - 1) < 1e-5
    inside = sum(100 - 10 * k for k in range(10))
    assert abs(sum(10 ** -m.log_class[k] * m.counts[m.classes == k].sum() for k in range(maxent.FREQUENT_CLASSES) if (m.classes == k).any()) - len(set(m.classes))) < 1e-9 and inside == 550


def test_maxent_sums_by_key():
    """Gradients by feature, with features of one row, of MANY and around it, and of more; no key's rows are lost."""
    rng = np.random.default_rng(8)
    for sizes in ([1], [3], [maxent.MANY], [maxent.MANY + 1], [700], [1, 2, maxent.MANY - 1, maxent.MANY, maxent.MANY + 1, 900, 1, 5], rng.zipf(1.5, 400) % 500 + 1):
        keys = rng.permutation(np.repeat(rng.permutation(3 * maxent.BUCKETS)[: len(sizes)], sizes)).astype(np.uint16)
        rows, at = rng.normal(size=(97, 48)).astype(np.float32), rng.integers(0, 97, len(keys))
        key, size, total = maxent.sums_by_key(rows, at, keys)
        assert sorted(key.tolist()) == sorted(set(keys.tolist()))
        for k, n, t in zip(key, size, total, strict=True):
            own = rows[at[keys == k]].astype(float)
            assert n == len(own) and np.abs(t - own.sum(axis=0)).max() < 1e-3


def test_maxent_softmax_of_large_weights():
    f = np.array([[0, 1, 2], [0, 0, 0], [0, 0, 0]])
    for scale in (1, 50, 300):
        w = np.zeros((3 * maxent.BUCKETS, maxent.CLASSES), np.float32)
        w[:3] = np.random.default_rng(scale).normal(size=(3, maxent.CLASSES)) * scale
        e = np.exp(w[:3].astype(float) - w[:3].max(axis=1, keepdims=True))
        p = maxent.softmax_rows(w, np.zeros(maxent.CLASSES, np.float32), f)
        assert np.isfinite(p).all() and np.abs(p - e / e.sum(axis=1, keepdims=True)).max() < 1e-5
    assert maxent.softmax_rows(w, np.zeros(maxent.CLASSES, np.float32), f[:, :0]).shape == (0, maxent.CLASSES)


def test_maxent_hashes_distinct_words_once(monkeypatch):
    """One list of the distinct words of a chunk is hashed, with the values that words have one by one."""
    asked = []
    hashed, distinct = spans.word_values, spans.distinct_values
    monkeypatch.setattr(spans, "distinct_values", lambda words: (asked.append(list(words)), distinct(words))[1])
    texts = ["Ab  aB\tab, \x0bÉ é \x1c \x00 ab\n".encode(), b"", b" \n", "漢 ab,".encode() + b" x" * 50]
    t = maxent.Tokens(texts)
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    want = [x for text in texts for x in (*hashed(text.lower().split()).tolist(), int(maxent.END_WORD))]
    assert t.hash.tolist() == want and maxent.Tokens([b"", b" "]).hash.tolist() == [int(maxent.END_WORD)] * 2


def test_maxent_lookup():
    keys = np.random.default_rng(0).integers(1 << 63, size=5000).astype(np.uint64)
    table = maxent.Lookup(keys)
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_classifier(spark):
    rng = np.random.default_rng(5)
    good = lambda: " ".join(f"w{k}" for k in rng.integers(0, 500, 80)) + "."
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = good().upper().replace(" ", "!! ") if bad else good()
        rows.append((i, text + (" insult nasty" if toxic else ""), "en", f"s{i % 9}"))
        if i % 2 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(None, None, None, None), (401, "", None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fitted = quality_classifier.fit(docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality_classifier.classify(docs, fitted).collect()}
    right = sum(got[i].kept == (i % 5 != 0 and i % 7 != 0) for i in range(400))
    assert len(got) == len(rows) and right >= 380
    assert quality_classifier.keep(docs, fitted).columns == docs.columns and quality_classifier.classify(docs.limit(0), fitted).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs, shingle=5).collect()} == {d for d, c in near.items() if d == c}
    cleaned = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    removed = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for d, r in cleaned.items():
        assert len(r.text.encode().split()) == removed[d].n_words - removed[d].n_removed and r.n_chars == len(r.text)
    assert {d for d, r in removed.items() if r.n_words > r.n_removed or r.n_removed == 0} == set(cleaned)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
