"""Builders of training sets: hard negatives, candidate lists with distractors, unused permutations, samples of exact size.

Everything "random" is an order by md5, row by row, so nothing has to meet in one task but where a count over a group is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from heapq import nsmallest
from itertools import islice, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import seeded

#: Most candidates that a prompt shows, and most distractors of a sample with one gold tool and with several.
CANDIDATES, SINGLE_DISTRACTORS, HARD_DISTRACTORS = 5, 4, 3
#: Rows of a sample that is taken by one sort.
AT_ONCE = 10_000


def seeded_number(seed: int, purpose: str, *key: Column) -> Column:
    """A number below 2**28 that the seed, the purpose and the key determine."""
    return F.conv(F.substring(seeded(seed, purpose, *key), 1, 7), 16, 10).cast("long")


def seeded_order(a: Column, seed: int, purpose: str, key: Column) -> Column:
    """The elements of an array of strings in seeded order."""
    hashed = F.transform(a, lambda t: F.struct(seeded(seed, purpose, key, t).alias("h"), t.alias("t")))
    return F.transform(F.sort_array(hashed), lambda s: s["t"])  # array_sort compares by an interpreted function


def first_n(a: Column, n: Column | int) -> Column:
    return F.slice(a, 1, n if isinstance(n, int) else F.greatest(n, F.lit(0)).cast("int"))


def seeded_rank(df: DataFrame, by: list[str], order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 1, among those that are the same in ``by``, in the order of ``order``, an md5 string, and no two alike. Rows are
    ranked in 4096 buckets by its first digits; what stands before a bucket is a sum of counts, of which there are 4096 for each value of ``by``."""
    rows = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h"))
    return rows.withColumn("__in", inside).join(counts, [*by, "__b"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__h", "__b", "__in", "__before")


def numbered(df: DataFrame, key: str, name: str = "n", buckets: int = 256) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of the number ``key``, no two of which are alike. Rows are numbered in ranges between quantiles; only
    the ranges' counts meet in one task."""
    edges = sorted(set(df.approxQuantile(key, [k / buckets for k in range(1, buckets)], 0.002)))
    which = F.lit(0)
    if edges:
        which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key).cast("double")))
    rows = df.withColumn("__b", which)
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.withColumn("__before", before).drop("__n"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return rows.withColumn("__in", inside).join(counts, "__b").withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def exact_sample(df: DataFrame, n: int, order: Column) -> DataFrame:
    """n rows by seeded order, or all if there are fewer."""
    if n <= AT_ONCE:  # each task keeps so many
        return df.withColumn("__h", order).orderBy("__h").limit(n).drop("__h")
    return seeded_rank(df, [], order, "__place").where(F.col("__place") <= n).drop("__place")


def cut_at(counts: list[tuple[int, str, int]], target: int) -> tuple[int, str, int] | None:
    """Of sorted (round, bucket, rows) the round and bucket that the first ``target`` rows end in, and how many of its rows are among them; None if there aren't more rows."""
    for k, bucket, n in counts:
        if n > target:
            return k, bucket, max(target, 0)
        target -= n
    return None


def catalog_row(catalog: DataFrame) -> DataFrame:
    """One row of a small catalog (tool, category, description, place): names in order, and maps from tool to category and description and from category to tools."""
    by_category = catalog.groupBy("category").agg(F.array_sort(F.collect_list("tool")).alias("tools")).agg(F.map_from_entries(F.collect_list(F.struct("category", "tools"))).alias("tools_of"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("tool", c)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "tool"))), lambda s: s["tool"])
    return catalog.agg(listed.alias("names"), pairs("category").alias("category_of"), pairs("description").alias("description_of")).crossJoin(by_category)


def hard_negatives(gold: Column, mode: str, seed: int, key: Column) -> Column:
    """Names of negatives for a row's gold tools, beside the columns of ``catalog_row``.

    ``single``: one of the gold tool's category, one of another, filled up to two. ``multi_partial``: half of the gold tools stay (one at least), the others are
    replaced by tools of their categories (any, if there are none), and one more is drawn; three at most, filled up to three. The gold tools that stay are
    false negatives on purpose. ``multi_random``: three that are not gold."""
    spare = F.array_except("names", gold)
    pick = lambda a, purpose, n: first_n(seeded_order(a, seed, purpose, key), n)
    category = lambda t: F.element_at(F.col("category_of"), t)
    related = lambda tools: F.array_except(F.flatten(F.transform(tools, lambda t: F.element_at(F.col("tools_of"), category(t)))), gold)
    if mode == "multi_random":
        return pick(spare, "random", 3)
    if mode == "single":
        same = related(first_n(gold, 1))
        found = F.concat(pick(same, "same", 1), pick(F.array_except(spare, same), "cross", 1))
        return first_n(F.concat(found, seeded_order(F.array_except(spare, found), seed, "fill", key)), 2)
    if mode != "multi_partial":
        raise ValueError(f"no such mode: {mode}")
    n = F.size(gold)
    keep = F.greatest(F.lit(1), F.floor(n / 2)).cast("int")
    kept = pick(gold, "keep", keep)
    of_others = related(F.array_except(gold, kept))
    pool = F.when(F.size(of_others) > 0, of_others).otherwise(spare)
    replaced = pick(pool, "replace", n - keep)
    rest = seeded_order(F.array_except(spare, replaced), seed, "fill", key)
    return first_n(F.concat(kept, replaced, rest), 3)


def hard_negative_rows(samples: DataFrame, catalog: DataFrame, partial: int, seed: int = 42) -> DataFrame:
    """id, mode, pos, neg (descriptions) of each of ``samples`` (id, gold) with a positive and a negative. One gold tool: ``single``; of the others the first ``partial``
    by id are ``multi_partial``, the rest ``multi_random``. Gold tools that the catalog lacks are passed over. ``catalog`` is as by ``catalog_row``."""
    many = samples.where(F.size("gold") > 1)
    first = many.select("id").orderBy("id").limit(partial).withColumn("partial", F.lit(True))
    rows = samples.where(F.size("gold") > 0).join(first, "id", "left").crossJoin(F.broadcast(catalog_row(catalog)))
    rows = rows.withColumn("mode", F.when(F.size("gold") == 1, "single").when(F.col("partial"), "multi_partial").otherwise("multi_random"))
    known = F.filter("gold", lambda t: F.array_contains("names", t))
    rows = rows.withColumn("gold", known).where(F.size("gold") > 0)
    found = F.when(F.col("mode") == "single", hard_negatives(F.col("gold"), "single", seed, F.col("id")))
    for mode in ("multi_partial", "multi_random"):
        found = found.when(F.col("mode") == mode, hard_negatives(F.col("gold"), mode, seed, F.col("id")))
    described = lambda tools: F.filter(F.transform(tools, lambda t: F.element_at(F.col("description_of"), t)), lambda d: d != "")
    out = rows.withColumn("found", found).select("id", "mode", described("gold").alias("pos"), described("found").alias("neg"))
    return out.where((F.size("pos") > 0) & (F.size("neg") > 0))


def single_samples(records: DataFrame, pools: DataFrame, per_tool: int, seed: int = 42) -> DataFrame:
    """question, tool, round, shown: exactly ``per_tool`` samples of each tool, if it has a record. Every record (question, tool) is used once a round, in seeded order, with one to four
    distractors of ``pools`` (tool, pool; one row a tool), in seeded order; a question never shows the same list twice."""
    counts = records.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    every = records.join(F.broadcast(pools.join(counts, "tool").where(F.size("pool") > 0)), "tool")  # a row for each tool
    rounds = F.when(F.col("n") >= per_tool, 1).otherwise(2 * F.ceil(F.lit(per_tool) / F.col("n")) + 8).cast("int")
    rows = every.withColumn("round", F.explode(F.sequence(F.lit(1), rounds)))
    key = F.concat_ws("-", "question", "round")
    number = 1 + seeded_number(seed, "count", key) % F.least(F.lit(SINGLE_DISTRACTORS), F.size("pool"))
    rows = rows.withColumn("shown", seeded_order(F.concat(F.array("tool"), first_n(seeded_order(F.col("pool"), seed, "draw", key), number)), seed, "show", key))
    rows = rows.groupBy("question", "tool", "shown").agg(F.min("round").alias("round"))
    place = F.row_number().over(Window.partitionBy("tool").orderBy("round", seeded(seed, "single", F.concat_ws("-", "question", "round"))))
    return rows.withColumn("__place", place).where(F.col("__place") <= per_tool).drop("__place")


def permutation_table(spark: SparkSession, most: int = CANDIDATES) -> DataFrame:
    """n, orders: all orders of n things but the given one; a row for each n from 2."""
    rows = [(n, [list(p) for p in permutations(range(1, n + 1))][1:]) for n in range(2, most + 1)]
    return spark.createDataFrame(rows, "n int, orders array<array<int>>")


def unused_orders(gold: Column, orders: Column, seed: int, key: Column, rounds: int) -> Column:
    """The first ``rounds`` other orders of the gold tools, in seeded order, each tools joined by commas."""
    listed = F.transform(orders, lambda p: F.array_join(F.transform(p, lambda i: F.element_at(gold, i)), ","))
    return first_n(seeded_order(listed, seed, "permutation", key), rounds)


def first_unused_orders(gold: Column, seed: int, key: Column, rounds: int) -> Column:
    """As ``unused_orders`` of ``permutation_table``. Most of a record's orders are only hashed, so this is Python."""

    def first(tools: list, start: bytes) -> list[bytes]:
        every = islice(permutations(tools), 1, None)
        shown = map(b",".join, every if None not in tools else ([t for t in p if t is not None] for p in every))
        return [t for _, t in nsmallest(rounds, [(md5(start + t).digest(), t) for t in shown])]

    @F.arrow_udf("array<string>")
    def orders(gold: pa.Array, key: pa.Array) -> pa.Array:
        starts = ("|".join([str(seed), "permutation", *([] if k is None else [k])]).encode() + b"|" for k in key.to_pylist())
        found = [first(tools, start) for tools, start in zip(gold.cast(pa.list_(pa.binary())).to_pylist(), starts, strict=True)]
        return pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))

    return orders(gold, key.cast("string"))


def multi_shuffle_samples(records: DataFrame, target: int | Callable[[int], int], rounds: int = 3, seed: int = 42) -> DataFrame:
    """id, round, shown (joined by commas), gold: every record (id, gold of 2 to ``CANDIDATES`` tools) once in another order than its own, then, round by round and in seeded order, in
    orders not yet used, until there are ``target``, which may be a function of the number of records. Fewer come out where orders or ``rounds`` are used up.

    Rows of each round are counted by the first digits of their hash; only those of the one of 4096 buckets that the target cuts are sorted."""
    most = F.least(F.lit(rounds), F.factorial(F.size("gold")) - 1).cast("int")
    rows = records.where(F.size("gold").between(2, CANDIDATES)).select("id", "gold", F.sequence(F.lit(1), most).alias("rounds"))
    hashed = lambda r: seeded(seed, "shuffled", F.col("id"), r)
    bucket = lambda r: F.substring(hashed(r), 1, 3)
    each = rows.select("id", F.explode("rounds").alias("round")).groupBy("round", bucket(F.col("round")).alias("bucket"))
    counts = sorted(tuple(r) for r in each.agg(F.count(F.lit(1))).collect())
    cut = cut_at(counts, target if isinstance(target, int) else target(sum(n for k, _, n in counts if k == 1)))
    if cut:
        k, at, left = cut
        whole = rows.withColumn("rounds", F.filter("rounds", lambda r: (r < k) | ((r == k) & (bucket(r) < at)))).where(F.size("rounds") > 0)
        last = rows.where((F.size("rounds") >= k) & (bucket(F.lit(k)) == at)).orderBy(hashed(F.lit(k))).limit(left)
        rows = whole.unionByName(last.withColumn("rounds", F.array(F.lit(k))))
    rows = rows.withColumn("unused", first_unused_orders(F.col("gold"), seed, F.col("id"), rounds)).withColumn("round", F.explode("rounds"))
    return rows.select("id", "round", F.element_at("unused", F.col("round")).alias("shown"), "gold")


def multi_hard_samples(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """id, shown: n of the records (id, gold, pool) that have room for a distractor and a pool of some, drawn without replacement, each with one distractor at least, and as many as
    ``HARD_DISTRACTORS``, the room and the pool allow at most; all in seeded order."""
    room = F.least(F.lit(HARD_DISTRACTORS), CANDIDATES - F.size("gold"), F.size("pool"))
    rows = records.withColumn("pool", F.array_except("pool", "gold")).withColumn("room", room).where("room >= 1")
    drawn = exact_sample(rows, n, seeded(seed, "hard sample", F.col("id")))
    number = 1 + seeded_number(seed, "hard count", F.col("id")) % F.col("room")
    shown = F.concat("gold", first_n(seeded_order(F.col("pool"), seed, "hard draw", F.col("id")), number))
    return drawn.select("id", "gold", seeded_order(shown, seed, "hard show", F.col("id")).alias("shown"))


def preference_pairs(wrong: DataFrame, every: DataFrame, synthetic: DataFrame, seed: int = 42) -> DataFrame:
    """query, chosen, rejected, source: one row for each query of ``every``: its hardest wrong prediction (``wrong``: query, id, chosen, rejected, hardness), else a made one
    (``synthetic``: query, id, chosen, rejected), of the smallest id. Chosen and rejected always differ."""
    differ = F.col("chosen") != F.col("rejected")
    best = wrong.where(differ).groupBy("query").agg(F.max(F.struct("hardness", seeded(seed, "natural", F.col("id")).alias("h"), "chosen", "rejected")).alias("x")).select("query", "x.chosen", "x.rejected", F.lit("natural").alias("source"))
    made = synthetic.where(differ).join(best, "query", "left_anti").groupBy("query").agg(F.min(F.struct("id", "chosen", "rejected")).alias("x")).select("query", "x.chosen", "x.rejected", F.lit("synthetic").alias("source"))
    return every.select("query").distinct().join(best.unionByName(made), "query")
