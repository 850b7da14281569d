"""Ordered tool traces: parsing, verdicts, error labels, training-set builders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.arrays import delete_at, insert_at, inversions, is_unique, minus, replace_at, swap_next
from ..functions.text import seeded
from .builders import seeded_rank

#: Fixed values of the data contract: the trace's key, verdicts and error labels.
KEY = "工具"
CORRECT, WRONG = "正确", "错误"
BAD_JSON, BAD_SHAPE, BAD_LIST, BAD_NAME = "JSON格式错误", "输出结构错误", "工具列表格式错误", "工具名格式错误"
UNKNOWN, OUTSIDE, REPEATED = "未知工具", "候选范围外工具", "重复工具"
MISSING, EXTRA, REPLACED, ORDER, OTHER = "遗漏工具", "多余工具", "错误工具替换", "工具顺序错误", "其他轨迹错误"
SHAPE = StructType([StructField("tools", ArrayType(StringType())), StructField("error", StringType())])


@F.pandas_udf(SHAPE)
def parse_shape(raw: pd.Series) -> pd.DataFrame:
    """Tools and error label of a raw answer: an object with one key that holds a list of strings that are not empty. JSON functions of the engine accept
    trailing text and single quotes, so this one is Python."""

    def one(text):
        try:
            value = json.loads(text or "")
        except (ValueError, RecursionError):
            return None, BAD_JSON
        if not isinstance(value, dict) or set(value) != {KEY}:
            return None, BAD_SHAPE
        tools = value[KEY]
        if not isinstance(tools, list) or not tools:
            return None, BAD_LIST
        if not all(isinstance(t, str) and t.strip() for t in tools):
            return None, BAD_NAME
        return tools, None

    return pd.DataFrame([one(x) for x in raw], columns=["tools", "error"])


def parse_errors(shape: Column, allowed: Column, candidates: Column | None = None) -> Column:
    """All labels of a parsed answer, in order."""
    tools = shape["tools"]
    found = [F.when(shape["error"].isNotNull(), shape["error"]), F.when(F.size(minus(tools, allowed)) > 0, UNKNOWN)]
    if candidates is not None:
        found.append(F.when(F.size(minus(F.array_intersect(tools, allowed), candidates)) > 0, OUTSIDE))
    found.append(F.when(~is_unique(tools), REPEATED))
    return F.array_compact(F.array(*found))


def first_error(shape: Column, allowed: Column, candidates: Column | None = None) -> Column:
    """The variant that stops at the first error."""
    return F.try_element_at(parse_errors(shape, allowed, candidates), F.lit(1))


def verdict(gold: Column, predicted: Column, error: Column | None = None) -> Column:
    right = F.coalesce(gold == predicted, F.lit(False))
    return F.when(right if error is None else right & error.isNull(), CORRECT).otherwise(WRONG)


def error_labels(gold: Column, predicted: Column) -> Column:
    """Which ways a trace differs from the gold one; none if it is the same."""
    missing, extra = F.size(minus(gold, predicted)) > 0, F.size(minus(predicted, gold)) > 0
    order = ~missing & ~extra & (F.size(gold) == F.size(predicted)) & is_unique(predicted) & (gold != predicted)
    labels = F.array_compact(F.array(F.when(missing, MISSING), F.when(extra, EXTRA), F.when(missing & extra, REPLACED), F.when(order, ORDER)))
    return F.when(gold == predicted, F.array().cast("array<string>")).when(F.size(labels) == 0, F.array(F.lit(OTHER))).otherwise(labels)


def trace_json(tools: Column) -> Column:
    """Canonical compact JSON of a trace."""
    return F.to_json(F.struct(tools.alias(KEY)))


def from_events(events: DataFrame) -> DataFrame:
    """(user_id, block, gold, pred, cand): six events in a row are a block; its first three are the gold trace, its last three the
    predicted one, all six the candidates, each type once in order of first occurrence."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select("user_id", "event_type", rn.alias("rn")).select("user_id", F.floor(F.col("rn") / 6).cast("long").alias("block"), (F.col("rn") % 6).alias("k"), "event_type")
    first = rows.groupBy("user_id", "block", "event_type").agg(F.min(F.when(F.col("k") < 3, F.col("k"))).alias("g"), F.min(F.when(F.col("k") >= 3, F.col("k"))).alias("p"), F.min("k").alias("c"))
    listed = lambda at: F.transform(F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("k"), "event_type")))), lambda x: x["event_type"])
    return first.groupBy("user_id", "block").agg(listed("g").alias("gold"), listed("p").alias("pred"), listed("c").alias("cand"))


def hardness(gold: Column, shown: Column) -> Column:
    """Larger is harder: has a distractor, distractors, candidates, inversions."""
    n = F.size(F.array_except(shown, gold))
    return F.struct((n > 0).cast("int").alias("has"), n.alias("n"), F.size(shown).alias("size"), inversions(gold, shown).alias("inversions"))


def alpaca(instruction: Column, shown: Column, question: Column, gold: Column) -> list[Column]:
    listed = F.array_join(F.transform(shown, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". 工具名："), t)), "\n")
    return [instruction.alias("instruction"), F.concat(F.lit("【候选工具】\n"), listed, F.lit("\n【用户问题】\n"), question).alias("input"), trace_json(gold).alias("output")]


def synthetic_negatives(queries: DataFrame, seed: int = 42) -> DataFrame:
    """``queries`` (key, gold, cand) with error_type and rejected: one feasible change each, types in turn inside each class of feasible
    types. No tool list equals its gold; queries that allow no change are dropped."""
    spare = F.array_sort(F.array_except("cand", "gold"))
    n = F.size("gold")
    rows = queries.withColumn("spare", spare).withColumn(
        "types",
        F.array_compact(F.array(F.when(n > 1, "order"), F.when(n > 1, "missing"), F.when(F.size("spare") > 0, "extra"), F.when(F.size("spare") > 0, "replaced"))),
    )
    rows = rows.where(F.size("types") > 0)
    rows = seeded_rank(rows, ["types"], seeded(seed, "negative", F.col("key")), "turn").withColumn("turn", F.col("turn") - 1)
    rows = rows.withColumn("error_type", F.element_at("types", (F.col("turn") % F.size("types") + 1).cast("int")))
    one, g = F.lit(1), F.col("gold")
    rejected = F.when(F.col("error_type") == "order", swap_next(g, one)).when(F.col("error_type") == "missing", delete_at(g, n)).when(F.col("error_type") == "extra", insert_at(g, n + 1, F.try_element_at(F.col("spare"), one))).otherwise(replace_at(g, one, F.try_element_at(F.col("spare"), one)))
    return rows.withColumn("rejected", rejected).drop("turn", "types", "spare")
