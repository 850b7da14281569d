"""Traces: verdicts, error labels, parsing, builders and contracts over six-event blocks of ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import seeded
from ..operators import traces as T
from ..operators import validate as V
from ..operators.relational import keep
from .registry import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
TRACES = """
e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
f AS (SELECT user_id, rn // 6 AS block, event_type, min(rn % 6) FILTER (rn % 6 < 3) AS g, min(rn % 6) FILTER (rn % 6 >= 3) AS p, min(rn % 6) AS c FROM e GROUP BY ALL),
t AS (SELECT user_id, block, coalesce(list(event_type ORDER BY g) FILTER (g IS NOT NULL), []) AS gold,
  coalesce(list(event_type ORDER BY p) FILTER (p IS NOT NULL), []) AS pred, list(event_type ORDER BY c) AS cand FROM f GROUP BY user_id, block),
m AS (SELECT *, list_filter(gold, lambda x: NOT list_contains(pred, x)) AS missing, list_filter(pred, lambda x: NOT list_contains(gold, x)) AS extra,
  list_filter(cand, lambda x: NOT list_contains(gold, x)) AS spare FROM t)
"""
LABELS = f"""CASE WHEN gold = pred THEN '' ELSE array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN '{T.MISSING}' END, CASE WHEN len(extra) > 0 THEN '{T.EXTRA}' END,
 CASE WHEN len(missing) > 0 AND len(extra) > 0 THEN '{T.REPLACED}' END, CASE WHEN len(missing) = 0 AND len(extra) = 0 THEN '{T.ORDER}' END], lambda x: x IS NOT NULL), ',') END"""


def traces(spark, sf):
    return T.from_events(read(spark, sf, "events"))


def text(c):
    return F.array_join(c, ",")


def key():
    return F.concat_ws("-", "user_id", "block")


@_r.add(f"WITH {TRACES} SELECT user_id, block, array_to_string(gold, ',') AS gold, array_to_string(pred, ',') AS pred, CASE WHEN gold = pred THEN '{T.CORRECT}' ELSE '{T.WRONG}' END AS verdict FROM t")
def i11_trace_verdict(spark, sf):
    return traces(spark, sf).select("user_id", "block", text("gold").alias("gold"), text("pred").alias("pred"), T.verdict(F.col("gold"), F.col("pred")).alias("verdict"))


@_r.add(f"WITH {TRACES} SELECT user_id, block, {LABELS} AS labels FROM m")
def i12_trace_error_taxonomy(spark, sf):
    return traces(spark, sf).select("user_id", "block", text(T.error_labels(F.col("gold"), F.col("pred"))).alias("labels"))


KINDS = "CASE WHEN len(gold) = 1 THEN 'single' ELSE 'multi' END"


@_r.add(f"WITH {TRACES} SELECT coalesce({KINDS}, 'all') AS kind, count(*) AS total, count(*) FILTER (gold = pred) AS correct, round(count(*) FILTER (gold = pred) / count(*), 6) AS accuracy FROM t GROUP BY ROLLUP ({KINDS})")
def e08_trace_stats_rollup(spark, sf):
    kind = F.when(F.size("gold") == 1, "single").otherwise("multi").alias("k")
    right = F.count_if(F.col("gold") == F.col("pred"))
    rows = traces(spark, sf).select(kind, "gold", "pred").rollup("k").agg(F.count(F.lit(1)).alias("total"), right.alias("correct"))
    return rows.select(F.coalesce("k", F.lit("all")).alias("kind"), "total", "correct", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))


@_r.add(f"WITH {TRACES}, l AS (SELECT unnest(string_split({LABELS}, ',')) AS label, user_id * 100000 + block AS pos FROM m) SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(pos)) AS place FROM l WHERE label <> '' GROUP BY label")
def e09_error_most_common(spark, sf):
    rows = traces(spark, sf).select(F.explode(T.error_labels(F.col("gold"), F.col("pred"))).alias("label"), (F.col("user_id") * 100000 + F.col("block")).alias("at"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select("label", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long").alias("place"))




@_r.add(
    f"WITH r AS (SELECT event_id, event_id % 8 AS rn, event_type FROM events) SELECT event_id, CASE rn WHEN 1 THEN '{T.BAD_JSON}' WHEN 2 THEN '{T.BAD_LIST}' WHEN 3 THEN '{T.BAD_LIST}' WHEN 4 THEN '{T.BAD_SHAPE}' WHEN 5 THEN '{T.BAD_NAME}' WHEN 6 THEN '{T.REPEATED}' WHEN 7 THEN '{T.UNKNOWN}' ELSE '' END AS errors FROM r"
)
def i10_trace_strict_parse(spark, sf):
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    e, k = F.col("event_type"), F.col("event_id") % 8
    raw = (
        F.when(k == 0, q('{"工具":["', e, '"]}')).when(k == 1, q('{"工具":["', e, '"]} zzz')).when(k == 2, '{"工具":[]}').when(k == 3, q('{"工具":"', e, '"}'))
        .when(k == 4, '{"工具":["a"],"x":1}').when(k == 5, '{"工具":[null]}').when(k == 6, q('{"工具":["', e, '","', e, '"]}')).otherwise('{"工具":["nope"]}')
    )
    events = read(spark, sf, "events")
    allowed = events.agg(F.sort_array(F.collect_set("event_type")).alias("allowed"))  # one row
    rows = events.select("event_id", T.parse_shape(raw).alias("shape")).crossJoin(F.broadcast(allowed))
    return rows.select("event_id", text(T.parse_errors(F.col("shape"), F.col("allowed"))).alias("errors"))


@_r.add(f"WITH {TRACES} SELECT user_id, block, (SELECT count(*) FROM (SELECT unnest(range(1, len(gold) + 1)) AS i) a, (SELECT unnest(range(1, len(gold) + 1)) AS j) b WHERE i < j AND list_position(rc, gold[i]) > list_position(rc, gold[j])) AS inversions FROM (SELECT *, list_reverse(cand) AS rc FROM t)")
def h25_inversion_count(spark, sf):
    return traces(spark, sf).select("user_id", "block", A.inversions(F.col("gold"), F.reverse("cand")).cast("long").alias("inversions"))


@_r.add(
    f"WITH {TRACES}, w AS (SELECT array_to_string(list_sort(gold), ',') AS q, user_id, block, len(spare) AS n, len(cand) AS size FROM m WHERE gold <> pred) SELECT q, user_id, block FROM w QUALIFY row_number() OVER (PARTITION BY q ORDER BY (n > 0)::INT DESC, n DESC, size DESC, md5(concat_ws('|', '42', 'hardest', user_id::VARCHAR, block::VARCHAR))) = 1"
)
def f06_hardest_variant(spark, sf):
    w = traces(spark, sf).where("gold <> pred").select(text(F.array_sort("gold")).alias("q"), "user_id", "block", F.size(A.minus(F.col("cand"), F.col("gold"))).alias("n"), F.size("cand").alias("size"))
    order = [(F.col("n") > 0).cast("int").desc(), F.desc("n"), F.desc("size"), seeded(42, "hardest", F.col("user_id"), F.col("block"))]
    return keep(w, ["q"], order).select("q", "user_id", "block")


@_r.add(f"WITH {TRACES} SELECT user_id, block, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, gold = pred AS same, len(list_filter(gold, lambda x: NOT list_contains(pred, x))) = 0 AS subset FROM m")
def h24_missing_extra(spark, sf):
    g, p = F.col("gold"), F.col("pred")
    return traces(spark, sf).select("user_id", "block", text(A.minus(g, p)).alias("missing"), text(A.minus(p, g)).alias("extra"), (g == p).alias("same"), A.subset(g, p).alias("subset"))


BLOCKS = "e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events), a AS (SELECT user_id, rn // 6 AS block, list(event_type ORDER BY rn) AS a FROM e GROUP BY ALL)"


def blocks(spark, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = read(spark, sf, "events").select("user_id", "event_type", rn.alias("rn")).withColumn("block", F.floor(F.col("rn") / 6).cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"])
    return rows.groupBy("user_id", "block").agg(listed.alias("a"))


@_r.add(f"WITH {BLOCKS} SELECT user_id, block, len(a) = len(list_distinct(a)) AS is_unique, len(a) - len(list_distinct(a)) AS removed, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a) AS x, unnest(range(len(a))) AS i) GROUP BY x)) AS kept FROM a")
def g03_in_list_dedup(spark, sf):
    a = F.col("a")
    return blocks(spark, sf).select("user_id", "block", A.is_unique(a).alias("is_unique"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("removed"), text(F.array_distinct(a)).alias("kept"))


@_r.add(f"WITH {BLOCKS} SELECT user_id, block, array_to_string(list_filter(a, lambda x: NOT list_contains(['click', 'view'], x)), ',') AS unknown FROM a")
def c07_unknown_members(spark, sf):
    return blocks(spark, sf).select("user_id", "block", text(A.minus(F.col("a"), F.array(F.lit("click"), F.lit("view")))).alias("unknown"))


@_r.add(f"WITH {BLOCKS} SELECT user_id, block, array_to_string(list_concat(a[1:0], [a[2]], [a[1]], a[3:]), ',') AS swapped, array_to_string(a[2:], ',') AS deleted, array_to_string(list_concat(a[1:1], ['new'], a[2:]), ',') AS inserted, array_to_string(list_concat(['new'], a[2:]), ',') AS replaced FROM a WHERE len(a) >= 2")
def h26_list_edit(spark, sf):
    a, one = F.col("a"), F.lit(1)
    rows = blocks(spark, sf).where(F.size("a") >= 2)
    return rows.select("user_id", "block", text(A.swap_next(a, one)).alias("swapped"), text(A.delete_at(a, one)).alias("deleted"), text(A.insert_at(a, F.lit(2), F.lit("new"))).alias("inserted"), text(A.replace_at(a, one, F.lit("new"))).alias("replaced"))


@_r.add(f"WITH {TRACES} SELECT user_id, block, '选择工具' AS instruction, '【候选工具】' || chr(10) || array_to_string(list_transform(cand, lambda x, i: i::VARCHAR || '. 工具名：' || x), chr(10)) || chr(10) || '【用户问题】' || chr(10) || user_id || '-' || block AS input, '{{\"工具\":[' || array_to_string(list_transform(gold, lambda x: '\"' || x || '\"'), ',') || ']}}' AS output FROM t")
def j14_sft_alpaca_render(spark, sf):
    return traces(spark, sf).select("user_id", "block", *T.alpaca(F.lit("选择工具"), F.col("cand"), key(), F.col("gold")))


@_r.add(
    f"""WITH {TRACES}, n AS (SELECT user_id, block, gold, list_sort(spare) AS spare, list_concat(CASE WHEN len(gold) > 1 THEN ['order', 'missing'] ELSE [] END, CASE WHEN len(spare) > 0 THEN ['extra', 'replaced'] ELSE [] END) AS types, user_id || '-' || block AS k FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY types ORDER BY md5(concat_ws('|', '42', 'negative', k)), k) - 1 AS turn FROM n WHERE len(types) > 0), p AS (SELECT *, types[turn % len(types) + 1] AS error_type FROM o)
SELECT user_id, block, error_type, array_to_string(gold, ',') AS chosen, array_to_string(CASE error_type WHEN 'order' THEN list_concat([gold[2]], [gold[1]], gold[3:]) WHEN 'missing' THEN gold[1:len(gold) - 1] WHEN 'extra' THEN list_concat(gold, [spare[1]]) ELSE list_concat([spare[1]], gold[2:]) END, ',') AS rejected FROM p"""
)
def j16_dpo_pairs(spark, sf):
    rows = T.synthetic_negatives(traces(spark, sf).select("user_id", "block", "gold", "cand", key().alias("key")))
    return rows.select("user_id", "block", "error_type", text("gold").alias("chosen"), text("rejected").alias("rejected"))


@_r.add(f"WITH {TRACES}, s AS (SELECT unnest(gold) AS tool FROM t) SELECT x.tool, count(s.tool) AS n FROM (SELECT DISTINCT event_type AS tool FROM events UNION ALL SELECT 'never') x LEFT JOIN s USING (tool) GROUP BY x.tool")
def e11_coverage_left_join(spark, sf):
    every = read(spark, sf, "events").select(F.col("event_type").alias("tool")).distinct().union(spark.createDataFrame([("never",)], "tool string"))
    counts = traces(spark, sf).select(F.explode("gold").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@_r.add(f"WITH {TRACES} SELECT user_id, count(DISTINCT gold) AS golds, count(*) AS n, count(DISTINCT gold) = 1 AS one FROM t GROUP BY user_id")
def e13_one_gold_per_key(spark, sf):
    rows = traces(spark, sf).select("user_id", T.trace_json(F.col("gold")).alias("g"))
    return rows.groupBy("user_id").agg(F.count_distinct("g").alias("golds"), F.count(F.lit(1)).alias("n")).withColumn("one", F.col("golds") == 1)


@_r.add(f"WITH {TRACES} SELECT round(avg((len(missing) = 0)::INT), 4) AS strict, round(avg((len(missing) < len(gold))::INT), 4) AS loose, count(*) AS total FROM m")
def e06_strict_loose_match(spark, sf):
    missing = F.size(A.minus(F.col("gold"), F.col("pred")))
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    return traces(spark, sf).agg(rate(missing == 0).alias("strict"), rate(missing < F.size("gold")).alias("loose"), F.count(F.lit(1)).alias("total"))


@_r.add(f"WITH {TRACES} SELECT len(gold) AS size, count(*) AS n FROM t GROUP BY 1")
def e10_value_distribution(spark, sf):
    return traces(spark, sf).groupBy(F.size("gold").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@_r.add(f"WITH {TRACES} SELECT array_to_string(gold, ',') AS gold, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1")
def e12_dup_groups(spark, sf):
    return traces(spark, sf).groupBy(text("gold").alias("gold")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_r.add("WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ' -> ' ORDER BY event_type) AS context FROM e GROUP BY user_id")
def d14_chain_context_concat(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct("event_type", F.concat("event_type", F.lit("="), F.col("n").cast("string")).alias("x"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), " -> ").alias("context"))


