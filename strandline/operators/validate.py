"""Dataset contracts: each rule gives the rows that break it, as (rule, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule; a rule is a condition that must hold, null counting as broken. One pass over ``df``."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("id"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def compare(saved: DataFrame, fresh: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that one side lacks, and fields that differ (nulls equal nulls)."""
    both = saved.select(key, F.struct(*fields).alias("a")).join(fresh.select(key, F.struct(*fields).alias("b")), key, "full_outer")
    differ = F.array_compact(F.array(F.when(F.col("a").isNull(), "not saved"), F.when(F.col("b").isNull(), "not expected"), *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f"differs: {f}") for f in fields]))
    return both.select(F.explode(differ).alias("rule"), F.col(key).cast("string").alias("id"))


def contiguous(df: DataFrame, key: str) -> DataFrame:
    """Gaps in ids that should run without one: each id but the least whose predecessor is missing."""
    ids = df.select(F.col(key).alias("id"))
    open_ = ids.join(ids.select((F.col("id") + 1).alias("id")), "id", "left_anti").crossJoin(F.broadcast(ids.agg(F.min("id").alias("least"))))
    return open_.where("id > least").select(F.lit("gap").alias("rule"), F.col("id").cast("string").alias("id"))
