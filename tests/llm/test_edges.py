"""Brute force for the classifier and the rules, words built to collide, the index across calls, and edge cases of every stage and query."""

import collections
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import maxent, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup
from strandline.llm.queries import QUERIES, documents
from strandline.llm.rolling import Levels, word_values

CLASHES = "id tag row text2 z size spans salt at hot n fp root head node one h stats found meta pointer word __id __own __hash start stop base ` a.b".split()


def words(n, seed, size=40):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, size, n))


def thue_morse(n=1024):
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_levels_of_equal_and_other_spans():
    rng = np.random.default_rng(0)
    for raw in (rng.integers(97, 100, 3000).astype(np.uint8), rng.integers(0, 3, 3000).astype(np.uint64), np.full(3000, 97, np.uint8)):
        levels = Levels(raw)
        for n in (1, 2, 3, 7, 8, 9, 33, 100):
            every = levels.all(n)
            at = rng.integers(0, 3000 - n, 300)
            assert (levels.spans(at, at + n) == every[at]).all()
            seen = {}
            for k in range(3000 - n + 1):
                assert seen.setdefault(raw[k : k + n].tobytes(), every[k]) == every[k]
            assert len(set(seen.values())) == len(seen)
        stop = rng.integers(1, 3000, 2000)
        start = (stop * rng.random(2000)).astype(np.int64)
        found = collections.defaultdict(set)
        for a, b, x in zip(start, stop, levels.spans(start, stop), strict=True):
            found[raw[a:b].tobytes()].add(int(x))
        assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == len(found)


def test_words_that_collide_under_polynomial_hashes(spark):
    a, b = thue_morse()
    assert len(set(word_values([a.encode(), b.encode()]).tolist())) == 2
    x = Levels(np.frombuffer((a + b).encode(), np.uint8)).all(1024)
    assert x[0] != x[1024]
    filler = words(60, 1, 1000).split()
    one, other = " ".join([*filler[:25], a, *filler[25:]]), " ".join([*filler[:25], b, *filler[25:]])
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 61}
    text = " ".join(["x y", a, "u v", "x y", b, "u v", *[f"q{k}" for k in range(20)]])
    assert quality_rules.measure(text.encode())[4] == 0
    is_held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train, held = next(d for d in range(99) if not is_held(d)), next(d for d in range(99) if is_held(d))
    got = {r.doc_id: r.n_known for r in maxent.score(spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string")).collect()}
    assert got == {train: 2, held: 1}
    pair = spark.createDataFrame([(1, a + a), (2, b + "c" * 500)], "doc_id long, text string")
    brute = brute_suffix([(a + a).encode(), (b + "c" * 500).encode()])
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(pair).collect()} == {1: brute[0], 2: brute[1]}


def brute_suffix(data, length=400):
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(int(m.sum()))
    return out


@pytest.mark.parametrize("length", [64, 70, 400])
def test_suffix_refinement(spark, length):
    """Passages of about the length, in many contexts, and periodic texts: all that the filters leave open."""
    rng = np.random.default_rng(length)
    letters = lambda n: "".join(rng.choice(list("ab"), n))
    shared = [letters(length + k) for k in (-1, 0, 1, 40)]
    texts = [letters(int(rng.integers(1, 300))) + shared[int(rng.integers(4))] + letters(int(rng.integers(1, 300))) for _ in range(60)]
    texts += ["ab" * length, "abc" * length, "a" * (length + 5), "a" * (length - 1), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_suffix([(t or "").encode() for t in texts], length)
    documents_ = suffix_dedup.keyed(docs)
    spans = suffix_dedup.repeated_spans(documents_, length, gram=length // 3, block=16)
    got = np.zeros(len(texts), int)
    for i, r in collections.defaultdict(list, {d: [x for x in spans.collect() if x.id == d] for d in range(len(texts))}).items():
        m = np.zeros(len((texts[i] or "").encode()), bool)
        for x in r:
            m[x.start : x.stop] = True
        got[i] = m.sum()
    assert got.tolist() == want
    assert suffix_dedup.steps(400) == (100, [100, 200]) and suffix_dedup.offsets([100, 200]) == [0, 100, 200, 300]


def test_index_across_calls(spark, tmp_path):
    rng = np.random.default_rng(4)
    passages = [words(70, 100 + k, 3000) for k in range(12)]
    texts = [" ".join([words(int(rng.integers(20, 90)), 900 + k, 3000), passages[int(rng.integers(12))], words(30, 2000 + k, 3000)]) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in substring_dedup.remove_repeats(docs).collect()}
    path = str(tmp_path / "index")
    got = []
    for k in range(6):
        batch = docs.where((F.col("doc_id") >= 15 * k) & (F.col("doc_id") < 15 * k + 15))
        index = substring_dedup.FingerprintIndex.open(spark, path) if k else substring_dedup.FingerprintIndex(spark, path, buckets=4)
        got += [tuple(r) for r in substring_dedup.deduplicate(index, batch).collect()]
        for name, _, _ in index.runs:  # as if another application opened it
            spark.sql(f"DROP TABLE {name}")
    assert set(got) == want and any(r[2] for r in got) and max(t for _, t, _ in index.runs) == 1
    late = spark.createDataFrame([(-5, texts[3])], "doc_id long, text string")
    r = substring_dedup.deduplicate(substring_dedup.FingerprintIndex.open(spark, path), late).first()
    assert r.n_removed == r.n_words


def test_rules_against_brute_force(spark):
    texts = [None, "", " \n", "a", words(9, 1), words(200, 2, 6), words(80, 3, 500) + " " + words(80, 3, 500), "a b c d e " * 4, "x | y # <\n" * 12, "é漢 ü\n\n" * 30 + words(300, 4, 900)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (5, texts[5])], "doc_id long, text string")
    space = " \t\n\r\v\f"
    import re

    want = []
    for d, t in [*enumerate(texts), (None, texts[5]), (5, texts[5])]:
        t = t or ""
        w = re.findall(f"[^{space}]+", t)

        def cover(n, w=w):
            count = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            hit = set()
            for i in range(len(w) - n + 1):
                if count[tuple(w[i : i + n])] > 1:
                    hit |= set(range(i, i + n))
            return hit

        lines, dup, dup_chars = set(), 0, 0
        for line in t.split("\n"):
            if line.strip(space):
                if line in lines:
                    dup += 1
                    dup_chars += sum(map(len, re.findall(f"[^{space}]+", line)))
                lines.add(line)
        chars = sum(map(len, w))
        shares = [sum(len(w[i]) for i in cover(n)) / chars if chars else 0.0 for n in (5, 7, 10)]
        failed = len(w) < 10 or 100 * len(cover(5)) > 20 * len(w)
        line_share = dup_chars / chars if chars else 0.0
        kept = not failed and line_share <= 0.30 and shares[0] <= 0.30 and shares[1] <= 0.25 and shares[2] <= 0.20
        want.append((d, len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover(5)), failed, kept, line_share, *shares))
    assert collections.Counter(tuple(r) for r in quality_rules.judge(docs).collect()) == collections.Counter(want)


def test_classifier_against_brute_force(spark, monkeypatch):
    """Scores on a small table, with the whole pool in one place and plain sorting."""
    q = quality_classifier
    monkeypatch.setattr(q, "PER_ROUND", 12)
    monkeypatch.setattr(q, "SURE", 0.7)
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 3 == 0, i % 4 == 2
        text = words(60, 100 + i, 200)
        text = (text.upper() + " !!" if bad else text) + (" scum" * (i % 2 + 1) if toxic else "")
        rows.append((i if i % 50 != 49 else None, text, ["en", "fr", None][i % 3], f"s{i % 4}"))
        if i % 2 == 0 and i % 50 != 49:
            labels.append((i, int(not bad), int(toxic)))
    rows += rows[1:60:2] + [(1000 + k, None if k else "", "en", None) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    fitted = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = collections.Counter((r.doc_id, round(r.quality_score, 8), round(r.toxic_score, 8), r.kept) for r in q.classify(docs, fitted).collect())

    known = {d: (y, t) for d, y, t in labels}
    own, rest = [r for r in rows if r[0] in known], [r for r in rows if r[0] not in known]
    table: dict[bytes, int] = {}
    for k in (0, 1):
        count, n = {}, collections.Counter(bool(known[r[0]][k]) for r in own)
        for r in own:
            for w in set((r[1] or "").encode().lower().split()):
                count.setdefault(w, [0, 0])[not known[r[0]][k]] += 1

        def spread(x, n=n):
            a, b = x[0] / n[True], x[1] / n[False]
            return abs(a - b) / math.sqrt((a + b) / 2 * (1 / n[True] + 1 / n[False]) + 1e-12)

        best = sorted((w for w, x in count.items() if sum(x) >= q.LEAST_ROWS), key=lambda w: (-spread(count[w]), w))[: q.WORDS]
        for w in best:
            table.setdefault(w, len(table))
    key = lambda t: xxhash.xxh3_64_intdigest((t or "").encode()) >> 1

    def views(some):
        texts = [(t or "").encode() for _, t, _, _ in some]
        return q.text_view(*q.text_parts(texts, table), len(table)), q.meta_view(q.meta_parts([r[2] for r in some], [r[3] for r in some], list(map(len, texts))))

    own.sort(key=lambda r: (key(r[1]), q.meta_parts([r[2]], [r[3]], [len((r[1] or "").encode())])[0], known[r[0]]))
    models = {n: q.CoTrained(*views(own), np.array([bool(known[r[0]][k]) for r in own])) for k, n in enumerate(("quality", "toxic"))}
    pool = views(rest)
    short = q.meta_parts([r[2] for r in rest], [r[3] for r in rest], [len((r[1] or "").encode()) for r in rest])
    for _ in range(q.ROUNDS):
        for m in models.values():
            told = []
            for v, view in enumerate(m.views):
                z = np.round(view.logit(pool[v]), 6)
                for positive in (False, True):
                    surest: dict = {}
                    for j, x in enumerate(z if positive else -z):
                        if x > math.log(q.SURE / (1 - q.SURE)):
                            surest[key(rest[j][1])] = max(surest.get(key(rest[j][1]), (-math.inf,)), (x, short[j], j))
                    for h, (_, _, j) in sorted(sorted(surest.items(), key=lambda s: (-s[1][0], s[0]))[:12]):
                        told.append((v, h, (pool[0][j], pool[1][j]), positive))
            for one in told:
                m.teach(*one)
            m.train()
    assert all(len(t) > 5 for m in models.values() for t in m.taught)
    for m in models.values():
        m.finish()
    every = views(rows)
    scores = [m.score(*every) for m in models.values()]
    want = collections.Counter((r[0], round(float(a), 8), round(float(b), 8), bool(a >= 0.5 and b < 0.5)) for r, a, b in zip(rows, *scores, strict=True))
    close = lambda c: sorted((str(d), round(a, 6), round(b, 6), k) for (d, a, b, k), n in c.items() for _ in range(n))
    assert [x[0] for x in close(got)] == [x[0] for x in close(want)]
    assert all(abs(x[1] - y[1]) < 1e-4 and abs(x[2] - y[2]) < 1e-4 for x, y in zip(close(got), close(want), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns whose names clash."""
    long = words(40_000, 7, 5000)
    rows = [(k, words(60 + k, k, 800), "en", f"s{k % 3}", 9) for k in range(30)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (None, words(90, 300, 800), None, "s1", 1), (None, words(90, 301, 800), None, "s1", 1)]
    rows += [(5, words(70, 302, 800), "fr", "s0", 1), (5, words(70, 303, 800), "fr", "s0", 1), (6, " \n\t", "fr", None, 3), (40, long, "en", "s2", 1), (41, long, "en", "s2", 1)]
    rows += [rows[3]] * 4 + [(50 + k, rows[7][1], "en", "s1", 2) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)}).repartition(4)


def stages(spark, labels_dir):
    import corpus_pipeline

    return [(n, f) for n, f in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(25)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, odd, sf):
    import corpus_pipeline

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        same = stage(spark, plain, sf)
        if name == "best_fit_packing":
            count = lambda df: collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
            assert count(got) == count(same)
        else:
            assert got.columns == odd.columns
            assert collections.Counter(tuple(r)[:5] for r in got.select(plain.columns).collect()) == collections.Counter(tuple(r) for r in same.collect())
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_stages_keep_what_they_should(spark, odd):
    """Rules and passages row by row, near copies by text, whatever the ids."""
    import corpus_pipeline

    rows = [tuple(r)[:2] for r in odd.collect()]
    kept = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.rules(spark, odd, "").collect())
    assert kept == collections.Counter((d, t) for d, t in rows if quality_rules.measure((t or "").encode())[6])
    left = collections.Counter(r.text for r in corpus_pipeline.near_duplicates(spark, odd, "").collect() if r.text and r.text.strip())
    assert left == collections.Counter(dict.fromkeys((t for _, t in rows if t and t.strip()), 1))
    ids = {r.text: r.doc_id for r in simhash.keep_one(odd, shingle=5).collect()}
    assert ids[words(67, 7, 800)] == 7 and ids[words(40_000, 7, 5000)] == 40


def test_queries_ignore_other_columns(spark, odd, tmp_path):
    """The queries of whole documents, on odd rows, with and without clashing names, and on no rows."""
    few = odd.where("doc_id is null or doc_id < 20 or doc_id >= 40")
    few.write.parquet(f"{tmp_path}/a/documents.parquet")
    few.select("doc_id", "text").write.parquet(f"{tmp_path}/b/documents.parquet")
    few.limit(0).write.parquet(f"{tmp_path}/c/documents.parquet")
    for name in ("op1_bpe", "op2_simhash", "op4_suffix_dedup", "op6_quality_rules", "op9_substring_dedup"):
        a, b = (collections.Counter(tuple(r) for r in QUERIES[name](spark, f"{tmp_path}/{x}").collect()) for x in "ab")
        assert a == b and sum(a.values()) == documents(spark, f"{tmp_path}/a").count()
        assert QUERIES[name](spark, f"{tmp_path}/c").count() == 0


def test_maxent_score_against_brute_force(spark, monkeypatch):
    """A trained model's score, token by token, with words of frequent and of surface classes and unseen ones; its probabilities of all words and of the unseen add up to 1."""
    monkeypatch.setattr(maxent, "FREQUENT", 40)
    seen = []
    train = maxent.train_round
    monkeypatch.setattr(maxent, "train_round", lambda *a: (train(*a), seen.append(a[1]))[0])
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'lorem'[: k % 6]}{k}{'.' if k % 7 == 0 else ''}" for k in rng.zipf(1.3, 120) % 300) for _ in range(80)] + [None]
    while zlib.crc32(str(len(texts)).encode()) % 7 != 2:
        texts.append("")
    texts.append("Never  SEEN before,")  # held out
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(11)
    got = {r.doc_id: r for r in maxent.score(docs).collect()}
    m = seen[-1]
    assert np.abs(m.weights).max() > 0.01
    counts, kinds = collections.Counter(), {}
    tokens = {}
    for d, t in enumerate(texts):
        own = maxent.Tokens([(t or "").encode()])
        tokens[d] = list(zip(own.hash.tolist(), own.surface.tolist(), own.features().T.tolist(), strict=True))
        if not got[d].held_out:
            counts.update(own.hash.tolist())
            kinds |= dict(zip(own.hash.tolist(), own.surface.tolist(), strict=True))
    ranked = sorted(counts, key=lambda w: (-counts[w], np.uint64(w).astype(np.int64)))
    classes = {w: (int(m.classes[k]) if k < 40 else maxent.FREQUENT_CLASSES + kinds[w]) for k, w in enumerate(ranked)}
    mass, number = collections.Counter(), collections.Counter()
    for w, c in classes.items():
        mass[c] += counts[w]
        number[c] += c >= maxent.FREQUENT_CLASSES

    def share(w, surface):
        c = classes.get(w, maxent.FREQUENT_CLASSES + surface)
        free = c >= maxent.FREQUENT_CLASSES
        return c, (counts[w] + free) / max(1, mass[c] + number[c] + free)

    def chances(f):
        z = m.bias.astype(float) + sum(m.weights[j * maxent.BUCKETS + f[j]].astype(float) for j in range(3))
        e = np.exp(z - z.max())
        return e / e.sum()

    for d, own in tokens.items():
        want = 0.0
        for w, surface, f in own:
            c, s = share(w, surface)
            want += math.log10(chances(f)[c]) + math.log10(s)
        assert abs(got[d].score - want) < 1e-3 * max(1, len(own))
    assert any(w not in counts for own in tokens.values() for w, _, _ in own) and len(set(classes.values())) > 20
    p = chances(tokens[0][5][2])
    total = sum(p[c] * s for c, s in (share(w, 0) for w in classes))
    total += sum(p[maxent.FREQUENT_CLASSES + k] / max(1, mass[maxent.FREQUENT_CLASSES + k] + number[maxent.FREQUENT_CLASSES + k] + 1) for k in range(maxent.SURFACE_CLASSES))
    empty = sum(p[k] for k in range(maxent.FREQUENT_CLASSES) if not mass[k])
    assert abs(total + empty - 1) < 1e-6
