"""Queries whose tasks must not grow with the tables: what their plans must show, and odd rows."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators import builders as B
from strandline.plans import catalog
from strandline.plans.builder_queries import chains


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same_as_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    df = catalog.QUERIES[name](spark, folder).select(*want.columns)
    rows = lambda x: sorted(str(tuple(r)) for r in x)
    assert rows(df.collect()) == rows(want.fetchall())


def test_negatives_random_by_row(spark, tmp_path):
    rows = [(i, f"Brand#{i % 7}") for i in range(50)] + [(3, "Brand#1"), (3, "Brand#9"), (4, "Brand#4"), (60, None), (None, "Brand#2")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string").repartition(4).write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, "j07_negatives_random", str(tmp_path), "part")
    made = plan(catalog.QUERIES["j07_negatives_random"](spark, str(tmp_path)))
    assert "slice(" in made[made.index("Generate") :].splitlines()[0], "three rows a part go on, not one for each brand"


def test_first_unused_orders(spark):
    rows = [(1, ["b", "a"]), (2, ["c", "a", "b"]), (3, ["d", "c", "b", "a"]), (4, ["é", "d", "c", "b", "a"]), (5, ["a", None, "b"]), (None, ["x", "y", "z"])]
    df = spark.createDataFrame(rows, "id long, gold array<string>").join(B.permutation_table(spark), F.size("gold") == F.col("n"))
    for r in df.select(B.unused_orders(F.col("gold"), F.col("orders"), 42, F.col("id"), 3).alias("a"), B.first_unused_orders(F.col("gold"), 42, F.col("id"), 3).alias("b")).collect():
        assert r.a == r.b


@pytest.mark.parametrize("target", [0, 1, 40, 60, 61, 95, 130, 500])
def test_shuffled_samples_end_exactly(spark, target):
    records = spark.createDataFrame([(i, list("abcde")[: 2 + i % 4]) for i in range(60)], "id long, gold array<string>")
    got = B.multi_shuffle_samples(records, target)
    rows = sorted((r["round"], r.id) for r in got.collect())
    h = lambda k, i: hashlib.md5(f"42|shuffled|{i}|{k}".encode()).hexdigest()
    every = sorted(((k, h(k, i), i) for i in range(60) for k in (1, 2, 3) if k == 1 or i % 4), key=lambda x: x[:2])
    assert rows == sorted((k, i) for k, _, i in every[:target])
    assert "Window" not in plan(got), "no order over all rows"


def test_hard_samples_without_order_of_all(spark):
    rows = spark.range(500).select("id")
    got = B.exact_sample(rows, 20, F.md5(F.col("id").cast("string").cast("binary")))
    assert sorted(r.id for r in got.collect()) == sorted(sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:20])
    assert "Window" not in plan(got)


def test_chains_shuffle_lines_once(spark):
    made = chains(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
