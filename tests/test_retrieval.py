"""Dense retrieval by cells of products against the plain cross join, on vectors of odd kinds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.text import inner_product
from strandline.operators import every_pair, retrieval, scoring
from strandline.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def odd_vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "signs":  # ties everywhere
        rows = [(i, rng.choice([-1.0, 1.0], 16).tolist()) for i in range(700)]
    elif kind == "copies":  # large groups of equal vectors, and ids that repeat
        few = rng.standard_normal((3, 16)).tolist()
        rows = [(int(rng.integers(400)), few[int(rng.integers(3))]) for _ in range(900)]
    elif kind == "near":  # scores that differ by less than they are rounded to, and by less than single precision tells
        one = rng.standard_normal(16)
        rows = [(i, (one + rng.choice([1e-10, 1e-8, 1e-5]) * rng.standard_normal(16)).tolist()) for i in range(700)]
    elif kind == "lengths":
        rows = [(i, (rng.standard_normal(16) * 10.0 ** rng.integers(-12, 12)).tolist()) for i in range(700)]
    else:
        rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
        rows += [(300, None), (320, [None] * 16), (340, [1.0] * 15 + [None]), (360, [float("nan")] * 16), (380, [float("inf")] + [1.0] * 15), (400, [1.0] * 8), (420, []), (440, [1e300] * 16), (None, [1.0] * 16), (441, [1.0] * 8), (442, [1e200] * 16)]
    return rows


@pytest.mark.parametrize("kind", ["signs", "copies", "near", "lengths", "odd"])
def test_cells_equal_cross_join(spark, kind, monkeypatch):
    for name, value in {"LEAST_QUERIES": 8, "GROUP_BYTES": 1, "LEAST_GROUP": 130, "PACKED": 100, "ROWS": 5, "COLUMNS": 64, "AGAIN": 50}.items():
        monkeypatch.setattr(every_pair, name, value)
    v = spark.createDataFrame(odd_vectors(kind), "id long, v array<double>").repartition(3)
    asked, found = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), v.select(F.col("id").alias("item"), "v")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(retrieval.dense_topk(asked, found, 5)) == rows(retrieval.dense_topk(asked, found, 5, inner_product(F.col("q"), F.col("v"))))
    plain = retrieval.scored_pairs(asked, found, inner_product(F.col("q"), F.col("v"))).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    got, want = ({r.qid: (r.n, r.total) for r in df.collect()} for df in (retrieval.dense_sums(asked, found), plain))
    assert got.keys() == want.keys()
    for q, (n, total) in want.items():
        assert got[q][0] == n and (got[q][1] == total if total is None else got[q][1] == pytest.approx(total, rel=1e-9, abs=1e-6, nan_ok=True))


@pytest.mark.parametrize("name", ["i05_dense_topk", "d08_cross_join_score", "i15_fusion_grid"])
def test_no_row_for_each_pair(spark, name):
    made = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in made and "NestedLoopJoin" not in made


def test_first_of_group(spark):
    items = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0)] * 7 + [(None, 0), (3, None)], "item long, g int")
    asked = spark.createDataFrame([(0, 0), (1, 1), (38, 0), (99, 1), (5, 7)], "qid long, g int")
    got = {}
    for r in retrieval.first_of_group(asked, items, "g", 4).collect():
        got.setdefault(r.qid, []).append((r["rank"], r["item"]))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {0: [2, 4, 6, 8], 1: [3, 5, 7, 9], 38: [0, 0, 0, 0], 99: [1, 3, 5, 7]}


def test_gold_joins_few_items(spark, tmp_path):
    n = 4000
    spark.range(n).select(F.col("id").alias("vec_id"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    from strandline.plans.retrieval_queries import gold

    rows = gold(spark, str(tmp_path))
    assert rows.count() == sum(1 + q % 4 for q in range(0, n, 20))


def test_scores_in_documents_equal_join(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PAIRS", 40)
    monkeypatch.setattr(scoring, "CELLS", 60)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.geometric(0.15, n))
    docs = [(100 + i, text(int(rng.integers(0, 30)))) for i in range(300)] + [(500 + i, "w1 w2 w2") for i in range(30)]  # equal scores
    docs += [(101, "w1 w3"), (101, "w1 w3"), (102, text(9)), (None, "w1 w2"), (None, "w4"), (700, None), (701, ""), (702, "W1, w2!")]  # repeated and missing ids
    asked = [(i, text(6)) for i in range(100, 110)] + [(110, "w1 w1 w2"), (111, "nothing"), (112, None), (113, ""), (None, "w2"), (100, "w1 w9")]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "id long, text string")
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))  # noqa: E731, by three digits, so in the same order
    got = retrieval.bm25_topk(d, q, "id", "text", "id", "text", 7).select(F.col("qid").cast("string"), F.col("item").cast("string"), F.round("score", 6), "rank")
    want = retrieval.bm25_topk(as_text(d), as_text(q), "id", "text", "id", "text", 7).select("qid", "item", F.round("score", 6), "rank")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want)


def test_bm25_shuffles_few_rows(spark):
    made = plan(catalog.QUERIES["i02_bm25_topk"](spark, SF))
    assert "MapInArrow" in made, "scores are summed within documents"


@pytest.mark.parametrize("name", ["i13_rerank_lexical", "i14_rerank_summary"])
def test_rerank_leaves_texts_in_place(spark, name):
    made = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "LeftOuter" not in "".join(x for x in made.splitlines() if "item" in x and "qid" not in x) and "MapInArrow" in made
    assert any("BroadcastHashJoin [item" in x and "Inner" in x for x in made.splitlines())
