"""Writers: JSON lines with nulls, CSV, pivoted candidates, quarantine, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON line per row, nulls written out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``errorifexists`` creates only, ``overwrite`` replaces, ``append`` adds."""
    as_json(df).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def quarantine(bad: DataFrame, path: str, group: str = "grp", fragment: str = "fragment") -> None:
    """Fragments by group, line ends escaped."""
    bad.select(F.col(group), F.replace(F.col(fragment), F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def wide(ranked: DataFrame, k: int, name: str = "candidate_") -> DataFrame:
    """(qid, candidate_1 ... candidate_k) from (qid, item, rank)."""
    return ranked.where(F.col("rank") <= k).groupBy("qid").agg(*[F.max(F.when(F.col("rank") == i, F.col("item"))).alias(f"{name}{i}") for i in range(1, k + 1)])


def key_values(df: DataFrame) -> DataFrame:
    """(metric, value) rows from one row of numbers."""
    names = df.columns
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.metric", "m.value")


def guard_paths(*paths: str) -> None:
    """Raises ValueError if two of the paths are the same."""
    clean = [p.rstrip("/") for p in paths]
    if len(set(clean)) < len(clean):
        raise ValueError(f"paths collide: {paths}")


def append_history(df: DataFrame, path: str) -> None:
    """Adds rows to a history; each part has the header."""
    write_csv(df, path, "append")


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report of few rows as one JSON file."""
    as_json(df).coalesce(1).write.mode(mode).text(path)


def save_index(vectors: DataFrame, path: str) -> None:
    """Vectors and their metadata as parquet, in place of array, pickle and metadata files."""
    vectors.write.mode("errorifexists").parquet(path)


def rewrite(df: DataFrame, path: str) -> str:
    """Rewrites a table that ``df`` may read: the new version is written beside it, the old one becomes a backup. Returns the backup's path."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    where = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(where(f"{path}.bak"), True)
    if not (fs.rename(where(path), where(f"{path}.bak")) and fs.rename(where(f"{path}.new"), where(path))):
        raise OSError(f"could not replace {path}")
    return f"{path}.bak"


def loss_series(log: DataFrame) -> DataFrame:
    """step, loss from a trainer's log lines (JSON objects with step and loss; others are left out)."""
    rows = log.select(F.get_json_object("value", "$.step").try_cast("long").alias("step"), F.get_json_object("value", "$.loss").try_cast("double").alias("loss"))
    return rows.where("step is not null and loss is not null")
