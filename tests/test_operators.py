import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import text as X
from strandline.operators import plugins, relational, retrieval, traces, validate
from strandline.sources import jsonl, sinks
from strandline.streaming import resume


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    row = one(
        spark,
        X.strip_think(F.lit("<think>a\nb</think> x </think>")).alias("think"),
        X.strip_outer_fence(F.lit("```json\n{}\n```")).alias("fence"),
        X.split_keywords(F.lit(" 退货，物流;a ,, b")).alias("keys"),
        X.split_keywords(F.lit(None).cast("string")).alias("none"),
        X.narrow_punctuation(F.lit("“a”：b，c")).alias("narrow"),
        X.outermost_object(F.lit('x {"a": {"b": 1}} y')).alias("obj"),
        X.salvage(F.lit('{"类型": "电商类", "关键词": ["a", "b"')).alias("salvaged"),
        X.fallback_label(F.lit("这是闲聊")).alias("label"),
        X.render("{{{a}}} {b}", a=F.lit(1), b=F.lit("x")).alias("render"),
        X.binary(F.lit("是")).alias("yes"),
        X.binary(F.lit("0.5")).alias("half"),
        X.binary(F.lit(None).cast("string"), 0).alias("missing"),
        X.characters(F.lit("查库存")).alias("grams"),
    )
    assert row.think == "x" and row.fence == "{}" and row["keys"] == ["退货", "物流", "a", "b"] and row.none == []
    assert row.narrow == '"a":b,c' and row.obj == '{"a": {"b": 1}}' and row.salvaged.label == "电商类"
    assert row.label == "闲聊类" and row.render == "{1} x" and (row.yes, row.half, row.missing) == (1, 0, 0) and row.grams == ["查库", "库存"]


def test_array_functions(spark):
    a = F.array(*map(F.lit, "abc"))
    row = one(spark, A.inversions(a, F.array(*map(F.lit, "cba"))).alias("i"), A.swap_next(a, F.lit(2)).alias("s"), A.delete_at(a, F.lit(1)).alias("d"), A.unalias(F.array(F.lit("g'et_item_info"))).alias("u"))
    assert row.i == 3 and row.s == ["a", "c", "b"] and row.d == ["b", "c"] and row.u == ["get_item_info"]


@pytest.mark.parametrize(
    "raw, error",
    [('{"工具":["a"]}', None), ('{"工具":["a"]} x', traces.BAD_JSON), ("{'工具':['a']}", traces.BAD_JSON), ("[]", traces.BAD_SHAPE), ('{"工具":["a"],"b":1}', traces.BAD_SHAPE), ('{"工具":[]}', traces.BAD_LIST), ('{"工具":"a"}', traces.BAD_LIST), ('{"工具":[null]}', traces.BAD_NAME), ('{"工具":[1]}', traces.BAD_NAME), ("", traces.BAD_JSON)],
)
def test_strict_parse(spark, raw, error):
    assert spark.createDataFrame([(raw,)], "raw string").select(traces.parse_shape("raw").alias("s")).first().s.error == error


def test_parse_errors(spark):
    df = spark.createDataFrame([('{"工具":["a","a","z","c"]}',)], "raw string").select(traces.parse_shape("raw").alias("s"))
    allowed, shown = F.array(*map(F.lit, "abc")), F.array(F.lit("a"))
    row = df.select(traces.parse_errors(F.col("s"), allowed, shown).alias("all"), traces.first_error(F.col("s"), allowed, shown).alias("one")).first()
    assert row["all"] == [traces.UNKNOWN, traces.OUTSIDE, traces.REPEATED] and row.one == traces.UNKNOWN


def test_error_labels(spark):
    rows = [(["a"], ["a"]), (["a", "b"], ["a"]), (["a"], ["a", "b"]), (["a"], ["b"]), (["a", "b"], ["b", "a"])]
    got = [r.x for r in spark.createDataFrame(rows, "g array<string>, p array<string>").select(traces.error_labels(F.col("g"), F.col("p")).alias("x")).collect()]
    assert got == [[], [traces.MISSING], [traces.EXTRA], [traces.MISSING, traces.EXTRA, traces.REPLACED], [traces.ORDER]]


def test_scanner():
    text = '{"a": "}"} {"b": {"c": 1}}\n}{"d":\n "\\"{"}{"e": 1'
    assert list(jsonl.objects_in(text)) == ['{"a": "}"}', '{"b": {"c": 1}}', '{"d":\n "\\"{"}', '{"e": 1']


def test_repair_and_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "flow.jsonl").write_text('{"a": 1}\n`{“a”： 2}`\n{"a": 3, "思考": ["x"], "y"}\n{"a": oops}\n', encoding="utf-8")
    good, bad = jsonl.read_grouped(spark, str(tmp_path / "in"))
    rows = {r.pos: r for r in good.collect()}
    assert [json.loads(rows[k].json)["a"] for k in (0, 1, 2)] == [1, 2, 3] and [rows[k].attempt for k in (0, 1, 2)] == [1, 2, 4]
    assert json.loads(rows[2].json)["思考"] == ["x", "y"] and bad.count() == 1
    sinks.quarantine(bad, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_modes(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, ""), (3, "{")], "id long, line string")
    good, bad = jsonl.parse(rows, "a int", "quarantine")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [3]
    with pytest.raises(ValueError, match="line 3"):
        jsonl.parse(rows, "a int", "failfast")


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿问题,candidate1\n"a\nb",x\n', encoding="utf-8")
    df = jsonl.read_csv(spark, str(tmp_path / "c.csv"), ["query", "candidate_1"], {"问题": "query", "candidate1": "candidate_1"})
    assert df.first().query == "a\nb"
    with pytest.raises(ValueError):
        jsonl.read_csv(spark, str(tmp_path / "c.csv"), ["nope"])
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'
    with pytest.raises(Exception, match="exist"):
        sinks.write_jsonl(df, str(tmp_path / "j"))


@pytest.mark.parametrize("total", [0, 1, 7, 100])
def test_quotas_sum(spark, total):
    g = spark.createDataFrame([("a", 550), ("b", 880), ("c", 1), ("d", 1)], "k string, n long")
    assert sum(r.quota for r in relational.largest_remainder(g, "k", "n", total).collect()) == total
    assert sum(r.quota for r in relational.equal_quota(g, "k", total).collect()) == total


def test_quota_zero_base(spark):
    g = spark.createDataFrame([("a", 0), ("b", 0)], "k string, n long")
    assert {r.quota for r in relational.largest_remainder(g, "k", "n", 5).collect()} == {0}


def test_minmax_constant(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "q int, s double")
    assert {r.x for r in df.select(retrieval.minmax(F.col("s"), "q").alias("x")).collect()} == {0.0}


def test_synthetic_negatives_differ(spark):
    rows = [("1", ["a", "b"], ["a", "b", "c"]), ("2", ["a"], ["a"]), ("3", ["a"], ["a", "b"]), ("4", ["a", "b"], ["a", "b"])]
    out = traces.synthetic_negatives(spark.createDataFrame(rows, "key string, gold array<string>, cand array<string>")).collect()
    assert {r.key for r in out} == {"1", "3", "4"} and all(r.rejected != r.gold for r in out)


def test_partitioning_does_not_matter(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    quotas = spark.createDataFrame([(0, 5), (1, 7), (2, 0)], "g long, quota long")
    pick = lambda n: sorted(r.k for r in relational.sample_by_quota(df.repartition(n), quotas, "g", "k", 1).collect())
    assert pick(1) == pick(7) and len(pick(3)) == 12


def test_validation(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (4, -1)], "id int, n int")
    bad = validate.violations(df, "id", {"positive": F.col("n") > 0})
    assert {r.id for r in bad.collect()} == {"2", "4"}
    assert validate.contiguous(df, "id").count() == 1
    with pytest.raises(ValueError, match="positive"):
        relational.require(bad)


def test_generate_survives_failure(spark):
    def load():
        def model(prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    assert [r.answer for r in plugins.generate(df, load, batch=1).collect()] == ["A", None, "C"]


def test_stream_resumes(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(path)
    sink = lambda df, k: seen.append(df.count())
    resume.run_available(spark, path, "id long", sink, str(tmp_path / "ck"), 10)
    spark.range(2).write.mode("append").parquet(path)
    resume.run_available(spark, path, "id long", sink, str(tmp_path / "ck"), 10)
    assert sum(seen) == 5
