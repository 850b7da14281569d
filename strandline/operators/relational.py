"""Keep-first and keep-last, ordered union, checked joins, quotas, seeded samples, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded


def keep(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in columns] if last else columns)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key, with their rank; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def checked_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, report): the report has one row with counts of repeated keys and of keys that one side lacks."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    report = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("n_left") > 1).alias("left_repeated"),
        F.count_if(F.col("n_right") > 1).alias("right_repeated"),
        F.count_if(F.col("n_right").isNull()).alias("missing"),
        F.count_if(F.col("n_left").isNull()).alias("extra"),
    )
    return left.join(right, key), report


def require(violations: DataFrame) -> None:
    """Raises ValueError that names the first violations, if there are any."""
    if found := violations.limit(20).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['id']}" for r in found))


def equal_quota(groups: DataFrame, key: str, total: int) -> DataFrame:
    """The total in equal parts; what is left goes to the first keys."""
    n = groups.agg(F.count(F.lit(1)).alias("__n"))
    rn = F.row_number().over(Window.orderBy(key))
    return groups.crossJoin(F.broadcast(n)).withColumn("quota", (F.floor(F.lit(total) / F.col("__n")) + (rn <= F.lit(total) % F.col("__n")).cast("int")).cast("long")).drop("__n")


def largest_remainder(groups: DataFrame, key: str, base: str, total: Column | int) -> DataFrame:
    """The total in proportion to ``base``: whole parts, then one more by descending fraction, ties by key. A base of 0 in all gives 0."""
    total = F.lit(total) if isinstance(total, int) else total
    every = Window.partitionBy(F.lit(0))
    exact = groups.withColumn("__sum", F.sum(base).over(every)).withColumn("__exact", F.coalesce(F.try_divide(F.col(base) * total, F.col("__sum")), F.lit(0.0)))
    parts = exact.withColumn("__whole", F.floor("__exact")).withColumn("__fraction", F.round(F.col("__exact") - F.floor("__exact"), 9))
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__fraction"), key))
    left = total - F.sum("__whole").over(every)
    quota = F.col("__whole") + F.when((F.col("__sum") > 0) & (rn <= left), 1).otherwise(0)
    return parts.withColumn("quota", quota.cast("long")).drop("__sum", "__exact", "__whole", "__fraction")


def sample_by_quota(df: DataFrame, quotas: DataFrame, group: str, key: str, seed: int, purpose: str = "sample") -> DataFrame:
    """Exactly ``quota`` rows of each group, in seeded order, without replacement."""
    w = Window.partitionBy(group).orderBy(seeded(seed, purpose, F.col(key)), key)
    return df.join(F.broadcast(quotas.select(group, "quota")), group).withColumn("__rn", F.row_number().over(w)).where("__rn <= quota").drop("__rn", "quota")


def confusion(gold: Column, predicted: Column, positive) -> list[Column]:
    g, p = gold.eqNullSafe(F.lit(positive)), predicted.eqNullSafe(F.lit(positive))
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]


def classification_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tp, fp, fn, tn; 0.0 where the denominator is 0."""
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select(div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, replaced and extended by new ones; of repeated new keys the last (by ``seq``) wins."""
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    return keep(both, keys, ["__turn", "seq"], last=True).drop("__turn")
