"""Readers, writers, parsers, scalars, contracts and streams, over lines and files made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import builders as B
from ..operators import plugins as P
from ..operators import traces as T
from ..operators import validate as V
from ..sources import jsonl as J
from ..sources import settings as S
from ..sources import sinks as K
from ..sources.scratch import scratch
from ..streaming import resume as N
from .registry import Registry, read
from .trace_queries import KINDS, LABELS, TRACES, blocks, key, text, traces

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
#: The event types, as a small catalog of tools.
TOOLS = ["click", "error", "purchase", "signup", "view"]


def md5(c):
    return F.md5(c.cast("binary"))


def lit(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@_r.add("SELECT doc_id, quality, toxic FROM labels")
def a01_jsonl_round_trip(spark, sf):
    path = scratch(spark, "labels")
    K.write_jsonl(read(spark, sf, "labels").select("doc_id", "quality", "toxic"), path, "overwrite")
    rows = spark.read.text(path).select(F.lit(0).cast("long").alias("id"), F.col("value").alias("line"))
    good, _ = J.parse(rows, "doc_id long, quality int, toxic int", "failfast")
    return good.select("value.*")


@_r.add("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user, event_type AS kind FROM events")
def a02_generic_samples(spark, sf):
    lines = K.as_json(read(spark, sf, "events").select("event_id", "user_id", "event_type"))
    m = F.from_json("value", "map<string,string>")
    return lines.select(m["event_id"].alias("id"), m["user_id"].alias("user"), m["event_type"].alias("kind"))


def labelled_lines(spark, sf):
    """Labelled questions as lines, some broken by their number."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    good = lambda q, *t: lit('{"query":"', q, '","gold_tools":[', *t, "]}")
    one = lit('"', F.col("event_type"), '"')
    k = F.col("id") % 10
    line = F.when(k == 1, "  ").when(k == 2, good(F.lit(""), one)).when(k == 3, good(F.col("id"), F.lit(""))).when(k == 4, good(F.col("id"), F.lit('"nope"'))).when(k == 5, '{"query":').when(k == 6, good(F.concat(F.lit("again "), (F.col("id") / 100).cast("int").cast("string")), one)).otherwise(good(F.col("id"), one))
    return e.select("id", line.alias("line"))


BROKEN = "SELECT CASE event_id % 10 WHEN 1 THEN 'blank line' WHEN 2 THEN 'no question' WHEN 3 THEN 'no gold tool' WHEN 4 THEN 'unknown tool' WHEN 5 THEN 'not an object' END AS rule, event_id AS id FROM events WHERE event_id % 10 BETWEEN 1 AND 5"


@_r.add(BROKEN)
def a05_labelled_violations(spark, sf):
    return J.labelled_violations(labelled_lines(spark, sf), TOOLS)


@_r.add(f"{BROKEN} UNION ALL SELECT 'question met before', event_id FROM events WHERE event_id % 10 = 6 AND event_id % 100 <> 6")
def a06_labelled_unique(spark, sf):
    return J.labelled_violations(labelled_lines(spark, sf), TOOLS, unique_questions=True)


@_r.add("SELECT 'events' AS source, event_id AS id, CASE WHEN event_id % 4 = 1 THEN 'blank' ELSE 'not an object' END AS rule FROM events WHERE event_id % 4 IN (1, 2)")
def a07_strict_reader(spark, sf):
    k = F.col("event_id") % 4
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(k == 1, "").when(k == 2, "[1]").otherwise('{"a":1}').alias("line"))
    rule = F.when(X.is_blank(F.col("line")), "blank").when(~J.strict_object(F.col("line")), "not an object")
    return rows.select(F.lit("events").alias("source"), "id", rule.alias("rule")).where("rule is not null")


@_r.add(
    "SELECT event_id AS id, event_id::VARCHAR AS query, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'get_item_info,' || event_type WHEN 2 THEN event_type ELSE 'nope,' || event_type END AS tools, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS corrected, CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS removed, "
    "CASE event_id % 4 WHEN 3 THEN 'unknown tool' WHEN 1 THEN '' ELSE 'number of tools' END AS rule FROM events"
)
def a08_sft_source(spark, sf):
    e, k = F.col("event_type"), F.col("event_id") % 4
    listed = F.when(k == 0, lit('"', e, '"')).when(k == 1, lit('"g\'et_item_info","', e, '"')).when(k == 2, lit('"', e, '","', e, '"')).otherwise(lit('"nope","', e, '"'))
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), lit('{"query":"', F.col("event_id"), '","工具":[', listed, "]}").alias("line"))
    out = J.sft_source(rows, "multi", [*TOOLS, "get_item_info"])
    return out.select("id", "query", text("tools").alias("tools"), "corrected", "removed", F.coalesce("rule", F.lit("")).alias("rule"))


@_r.add(
    f"WITH {TRACES} SELECT user_id || '-' || block AS id, user_id || '-' || block AS question, array_to_string(cand, ',') AS candidates, array_to_string(gold, ',') AS gold, CASE WHEN block % 5 = 3 THEN 'keys' WHEN block % 5 = 4 THEN 'blank' ELSE '' END AS rule FROM t"
)
def a09_alpaca_rows(spark, sf):
    rows = traces(spark, sf).withColumn("id", key()).select("id", "block", *T.alpaca(F.lit("选择工具"), F.col("cand"), key(), F.col("gold")))
    whole = F.when(F.col("block") % 5 == 3, F.to_json(F.struct("instruction", "input", "output", F.lit(1).alias("more")))).when(F.col("block") % 5 == 4, F.to_json(F.struct(F.lit(" ").alias("instruction"), "input", "output"))).otherwise(F.to_json(F.struct("instruction", "input", "output")))
    out = J.alpaca_rows(rows.select("id", whole.alias("line")))
    return out.select("id", "question", text("candidates").alias("candidates"), text("gold").alias("gold"), F.coalesce("rule", F.lit("")).alias("rule"))


@_r.add("SELECT user_id, event_id, event_type AS kind FROM events")
def a10_object_scan(spark, sf):
    """All objects of a user in one text, one after another, over lines, with braces inside strings."""
    one = lit('{"id":', F.col("event_id"), ',\n"k":{"t":"', F.col("event_type"), '","s":"}{\\""}} ')
    whole = read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("o")))), lambda s: s["o"]), "").alias("text"))
    found = whole.select("user_id", F.explode(J.scan_objects("text")).alias("o"))
    return found.select("user_id", F.get_json_object("o", "$.id").cast("long").alias("event_id"), F.get_json_object("o", "$.k.t").alias("kind"))


@_r.add("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS attempt, CASE WHEN event_id % 5 < 4 THEN event_type END AS kind FROM events")
def a11_json_repair(spark, sf):
    e, k = F.col("event_type"), F.col("event_id") % 5
    good = lit('{"k": "', e, '"}')
    broken = F.when(k == 0, good).when(k == 1, lit("`{“k”： “", e, "”}`")).when(k == 2, lit("so: ", good, " yes")).when(k == 3, lit('{"k": "', e, '", "思考": ["a"], "b"}')).otherwise(lit('{"k": oops ', e))
    out = J.repair(read(spark, sf, "events").select("event_id", broken.alias("fragment")))
    return out.select("event_id", "attempt", F.get_json_object("json", "$.k").alias("kind"))


@_r.add("SELECT event_type AS grp, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def a12_grouped_scan(spark, sf):
    """Files by group, whose names tell the group."""
    path = scratch(spark, "groups")
    e = read(spark, sf, "events").select(F.col("event_type").alias("grp"), F.to_json(F.struct("event_id")).alias("value"))
    e.repartition("grp").write.partitionBy("grp").text(path)
    rows = spark.read.text(path).select("grp", F.get_json_object("value", "$.event_id").cast("long").alias("id"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@_r.add("SELECT n_nationkey AS index, n_name AS tool_name, 'about ' || n_name AS description FROM nation")
def a13_catalog_scan(spark, sf):
    rows = read(spark, sf, "nation").orderBy("n_nationkey").collect()  # a catalog is small, and stays in order
    path = scratch(spark, "catalog")
    spark.createDataFrame([(json.dumps({r.n_name: {"description": f"about {r.n_name}"} for r in rows}),)], "value string").coalesce(1).write.text(path)
    return J.catalog_frame(spark, json.loads(S.read_text(spark, path))).select("index", "tool_name", "description")


@_r.add("SELECT vec_id, label AS index, n_name AS tool FROM embeddings JOIN nation ON n_nationkey = label")
def a14_index_metadata(spark, sf):
    listed = read(spark, sf, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.struct(s["n_nationkey"].alias("index"), s["n_name"].alias("tool")))).alias("value"))
    path = scratch(spark, "metadata")
    listed.write.text(path)
    meta = spark.read.schema("index int, tool string").json(path, multiLine=True)
    return read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("index")).join(F.broadcast(meta), "index")


@_r.add("SELECT conv_id, turn, md5(text) AS text FROM conversations")
def a15_csv_round_trip(spark, sf):
    """Texts with commas, quotes and line ends, and a header with a byte-order mark."""
    path = scratch(spark, "csv")
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("﻿conv_id"), "turn", "text")
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return J.read_csv(spark, path, ["conv_id", "turn", "text"]).select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), md5(F.col("text")).alias("text"))


@_r.add("SELECT p_partkey AS query, p_brand AS candidate_1, p_type AS candidate_2 FROM part")
def a16_csv_aliases(spark, sf):
    path = scratch(spark, "aliases")
    K.write_csv(read(spark, sf, "part").select(F.col("p_partkey").alias("问题"), F.col("p_brand").alias("candidate1"), F.col("p_type").alias("candidate2")), path)
    found = J.read_csv(spark, path, ["query", "candidate_1", "candidate_2"], {"问题": "query", "candidate1": "candidate_1", "candidate2": "candidate_2"})
    return found.withColumn("query", F.col("query").cast("long"))


@_r.add("SELECT * FROM (VALUES ('model.name', '\"encoder\"'), ('model.batch', '16'), ('train.rate', '0.00001'), ('train.epochs', '3'), ('seed', '42')) v(key, value)")
def a18_settings_with_defaults(spark, sf):
    path = scratch(spark, "settings")
    spark.createDataFrame([("# run\nmodel:\n  name: encoder\ntrain:\n  rate: 0.00001  # low\n  epochs:\n",)], "value string").coalesce(1).write.text(path)
    settings = S.parse_settings(S.read_text(spark, path))
    settings["train"].pop("epochs")  # an empty section has nothing to say
    both = S.with_defaults(settings, {"model": {"name": "none", "batch": 16}, "train": {"rate": 0.1, "epochs": 3}, "seed": 42})
    values = S.flat(both) | {"train.rate": f"{both['train']['rate']:.5f}"}
    return spark.createDataFrame(list(values.items()), "key string, value string")


@_r.add("SELECT item_id, md5('Q: ' || text || ' {json}') AS prompt FROM benchmark")
def a19_template(spark, sf):
    path = scratch(spark, "template")
    spark.createDataFrame([("Q: {question} {{json}}",)], "value string").coalesce(1).write.text(path)
    template = S.read_text(spark, path).rstrip("\n")
    return read(spark, sf, "benchmark").select("item_id", md5(X.render(template, question=F.col("text"))).alias("prompt"))


@_r.add("SELECT vec_id, len(embedding)::INT AS size, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings")
def b14_index_persist(spark, sf):
    path = scratch(spark, "index")
    K.save_index(read(spark, sf, "embeddings").select("vec_id", "embedding", "label"), path)
    v = F.col("embedding")
    return spark.read.parquet(path).select("vec_id", F.size(v).alias("size"), F.round(X.inner_product(v, v), 6).alias("square"))


@_r.add("SELECT event_id FROM events WHERE event_id >= 500")
def a21_offset_scan(spark, sf):
    done = S.offset(" 500\n") + S.offset("") + S.offset(None)
    return read(spark, sf, "events").where(F.col("event_id") >= done).select("event_id")


@_r.add("SELECT o_orderstatus AS model, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def b04_csv_summary(spark, sf):
    path = scratch(spark, "summary")
    K.write_csv(read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")), path)
    return spark.read.schema("model string, n long, mean double").csv(path, header=True)


@_r.add("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, quality, toxic FROM labels")
def b03_append_batches(spark, sf):
    path, rows = scratch(spark, "batches"), read(spark, sf, "labels").select("doc_id", "quality", "toxic")
    for _ in range(2):
        K.write_jsonl(rows, path, "append")
    return spark.read.schema("doc_id long, quality int, toxic int").json(path)


@_r.add("SELECT count(*) AS rows, count(DISTINCT run) AS runs FROM (SELECT 1 AS run, * FROM region UNION ALL SELECT 2, * FROM region)")
def b08_history(spark, sf):
    path = scratch(spark, "history")
    for run in (1, 2):
        K.append_history(read(spark, sf, "region").withColumn("run", F.lit(run)), path)
    return spark.read.csv(path, header=True).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run").alias("runs"))


@_r.add("SELECT count(*) AS total, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM labels")
def b11_stats_json(spark, sf):
    path = scratch(spark, "stats")
    K.write_report(read(spark, sf, "labels").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")), path)
    return spark.read.schema("total long, good long, toxic long").json(path)


@_r.add("SELECT doc_id FROM labels WHERE toxic = 0")
def b12_rewrite_in_place(spark, sf):
    path = scratch(spark, "rewritten")
    read(spark, sf, "labels").write.parquet(path)
    K.rewrite(spark.read.parquet(path).where("toxic = 0"), path)
    return spark.read.parquet(path).select("doc_id")


@_r.add("SELECT event_id AS step, round(value / 10, 4) AS loss FROM events WHERE event_id % 3 = 0")
def b15_loss_series(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, lit('{"step": ', F.col("event_id"), ', "loss": ', F.round(F.col("value") / 10, 4), "}")).otherwise("saving model")
    return K.loss_series(read(spark, sf, "events").select(line.alias("value")))


@_r.add("SELECT doc_id AS id, text AS query, [source] AS gold_tools FROM documents")
def c01_canonical_shape(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"), F.array("source").alias("gold_tools"))


@_r.add(f"WITH {TRACES} SELECT user_id, block FROM m WHERE len(extra) > 0")
def c03_missing_filter(spark, sf):
    extra = A.minus(F.col("pred"), F.col("gold"))
    return traces(spark, sf).where(extra.isNotNull() & (F.size(extra) > 0)).select("user_id", "block")


@_r.add(f"WITH {TRACES} SELECT user_id, block, len(missing) = 0 AS within, len(gold) <= 2 AS eligible, gold = pred AS exact, len(gold) = len(list_distinct(gold)) AS is_unique FROM m")
def c08_trace_predicates(spark, sf):
    g, p = F.col("gold"), F.col("pred")
    return traces(spark, sf).select("user_id", "block", A.subset(g, p).alias("within"), (F.size(g) <= 2).alias("eligible"), (g == p).alias("exact"), A.is_unique(g).alias("is_unique"))


@_r.add("SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'und') AS any FROM documents")
def c11_keyword_any(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.contains_any(F.col("text"), ("the", "und")).alias("any"))


@_r.add("SELECT c_custkey, n_name AS negative FROM customer JOIN nation ON n_nationkey <> c_nationkey AND n_regionkey = 0")
def d12_candidate_negatives(spark, sf):
    every = read(spark, sf, "nation").where("n_regionkey = 0").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("every"))  # one row
    rows = read(spark, sf, "customer").crossJoin(F.broadcast(every))
    return rows.select("c_custkey", F.explode(F.filter("every", lambda n: n["n_nationkey"] != F.col("c_nationkey"))).alias("n")).select("c_custkey", F.col("n.n_name").alias("negative"))


@_r.add("SELECT a.n_name AS tool, string_agg(b.n_name, ',' ORDER BY b.n_name) FILTER (a.n_regionkey = b.n_regionkey) AS same, string_agg(b.n_name, ',' ORDER BY b.n_name) FILTER (a.n_regionkey <> b.n_regionkey) AS other FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY a.n_name")
def d13_category_pools(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_name").alias("tool"), F.col("n_regionkey").cast("string").alias("category"), F.col("n_nationkey").alias("place"), F.lit("").alias("description"))
    rows = n.select("tool", "category").crossJoin(F.broadcast(B.catalog_row(n)))
    same = F.array_except(F.element_at("tools_of", F.col("category")), F.array("tool"))
    return rows.select("tool", text(F.array_sort(same)).alias("same"), text(F.array_sort(F.array_except(F.array_except("names", same), F.array("tool")))).alias("other"))


@_r.add("SELECT event_type, round(avg(epoch_us(ts) % 1000000) / 1000, 3) AS mean_ms, count(*) AS n FROM events GROUP BY event_type")
def e05_mean_latency(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(F.unix_micros(F.col("ts").cast("timestamp_ltz")) % 1000000) / 1000, 3).alias("mean_ms"), F.count(F.lit(1)).alias("n"))


@_r.add(f"WITH {TRACES} SELECT gold[1] AS tool, count(*) AS n, min(len(gold)) AS least, max(len(gold)) AS most FROM t GROUP BY 1")
def e14_group_by_tool(spark, sf):
    size = F.size("gold").cast("long")
    return traces(spark, sf).groupBy(F.element_at("gold", 1).alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))


@_r.add("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low, max(o_totalprice) OVER (PARTITION BY o_custkey) AS high FROM orders")
def f01_rank_with_bounds(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    ranked = F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", ranked.alias("rank"), F.min("o_totalprice").over(w).alias("low"), F.max("o_totalprice").over(w).alias("high"))


@_r.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders")
def g02_global_number(spark, sf):
    """The place of every row in a global order, without one task for all."""
    return B.numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@_r.add("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|rank|' || o_orderkey)) AS rank FROM orders")
def f02_seeded_rank(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return B.seeded_rank(rows, ["o_orderpriority"], X.seeded(42, "rank", F.col("o_orderkey")))


@_r.add("SELECT p_brand, n * 1000.0 / t - floor(n * 1000.0 / t) > 0 AS fractional FROM (SELECT p_brand, count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY p_brand)")
def f09_fractions(spark, sf):
    b = read(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(b.agg(F.sum("n").alias("t")))
    e = F.col("n") * 1000 / F.col("t")
    return b.crossJoin(total).select("p_brand", (e - F.floor(e) > 0).alias("fractional"))


@_r.add("SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lang FROM documents")
def g06_union_distinct(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("source").union(d.select("lang")).distinct()


@_r.add("SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped, regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' AS blank, contains(lower(text), 'a') AS has_a FROM conversations")
def h01_strip_and_search(spark, sf):
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\n "))
    return read(spark, sf, "conversations").select("conv_id", "turn", md5(X.strip(padded)).alias("stripped"), X.is_blank(padded).alias("blank"), X.contains_any(F.col("text"), ("a",)).alias("has_a"))


@_r.add("SELECT conv_id, turn, md5(regexp_replace('x ```' || text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations")
def h03_outer_fence(spark, sf):
    fenced = F.concat(F.lit("```json x ```"), F.col("text"), F.lit("\n```"))
    return read(spark, sf, "conversations").select("conv_id", "turn", md5(X.strip_outer_fence(fenced)).alias("text"))


@_r.add("SELECT event_id, event_type || '，' || user_id AS joined, CASE event_id % 3 WHEN 0 THEN '电商类' WHEN 1 THEN '闲聊类' END AS label, '{' || event_type || '}' AS object FROM events")
def h08_parse_cascade(spark, sf):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, "这是电商问题").when(k == 1, "只是闲聊").otherwise("?")
    joined = X.join_keywords(X.split_keywords(lit(F.col("event_type"), " ；", F.col("user_id"), ",")))
    return read(spark, sf, "events").select("event_id", joined.alias("joined"), X.fallback_label(raw).alias("label"), X.outermost_object(lit("a ", "{", F.col("event_type"), "} b")).alias("object"))


@_r.add("SELECT event_id, '电商类' AS label, event_type || '|' || user_id AS keywords FROM events")
def h09_salvage(spark, sf):
    broken = lit('{"类型": "电商类", "关键词": ["', F.col("event_type"), '", "', F.col("user_id"), '"], oops')
    s = X.salvage(broken)
    return read(spark, sf, "events").select("event_id", s["label"].alias("label"), F.array_join(s["keywords"], "|").alias("keywords"))


@_r.add("SELECT * FROM (VALUES (1e-5, '1e-5', 'm_lr1e-5_e3_2'), (0.0002, '0.0002', 'm_lr0.0002_e3')) v(rate, shown, name)")
def h16_experiment_names(spark, sf):
    rows = [(r, S.short_rate(r), S.experiment_name("m", r, 3, {"m_lr1e-5_e3"})) for r in (1e-5, 0.0002)]
    return spark.createDataFrame(rows, "rate double, shown string, name string")


@_r.add("SELECT * FROM (VALUES ('base', '/m/a=b'), ('best.v2', 'x')) v(label, path)")
def h17_labelled_paths(spark, sf):
    return spark.createDataFrame(list(S.labelled_paths(["base=/m/a=b", "best.v2=x"]).items()), "label string, path string")


@_r.add(f"WITH {TRACES} SELECT user_id, block, '{{\"工具\":[' || array_to_string(list_transform(gold, lambda x: '\"' || x || '\"'), ',') || ']}}' AS json, array_to_string(gold, ',') AS back FROM t")
def h21_trace_json(spark, sf):
    rows = traces(spark, sf).select("user_id", "block", T.trace_json(F.col("gold")).alias("json"))
    return rows.select("user_id", "block", "json", text(T.parse_shape("json")["tools"]).alias("back"))


@_r.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'get_item_info' ELSE event_type END AS tool, (event_id % 2 = 0)::INT AS corrected FROM events")
def h23_aliases(spark, sf):
    raw = F.array(F.when(F.col("event_id") % 2 == 0, "g'et_item_info").otherwise(F.col("event_type")))
    right = A.unalias(raw)
    return read(spark, sf, "events").select("event_id", right[0].alias("tool"), (raw[0] != right[0]).cast("int").alias("corrected"))


@_r.add("SELECT o_orderkey, (o_orderkey // 7)::BIGINT AS whole, o_orderkey % 7 AS rest, factorial((o_orderkey % 7)::INT)::BIGINT AS f FROM orders")
def h31_whole_numbers(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey div 7").alias("whole"), (F.col("o_orderkey") % 7).alias("rest"), F.factorial((F.col("o_orderkey") % 7).cast("int")).alias("f"))


@_r.add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def h35_iso_time(spark, sf):
    return read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def scoped(spark, sf):
    """Raw answers that name a known, an unknown, a not shown and a repeated tool, with the shown ones."""
    one = lambda *t: lit('{"工具":[', F.array_join(F.array(*[lit('"', x, '"') for x in t]), ","), "]}")
    e, k = F.col("event_type"), F.col("event_id") % 5
    raw = F.when(k == 0, one(e)).when(k == 1, one(F.lit("nope"), e, e)).when(k == 2, one(F.lit("away"))).when(k == 3, one(e, F.lit("away"), e)).otherwise(F.lit("{"))
    shown, allowed = F.array("event_type"), F.array(*map(F.lit, [*TOOLS, "away"]))
    return read(spark, sf, "events").select("event_id", T.parse_shape(raw).alias("shape"), shown.alias("shown"), allowed.alias("allowed"))


@_r.add(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{T.UNKNOWN}' WHEN 2 THEN '' WHEN 3 THEN '{T.REPEATED}' ELSE '{T.BAD_JSON}' END AS first FROM events")
def i10_parse_first_error(spark, sf):
    return scoped(spark, sf).select("event_id", F.coalesce(T.first_error(F.col("shape"), F.col("allowed")), F.lit("")).alias("first"))


@_r.add(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{T.UNKNOWN}' WHEN 2 THEN '{T.OUTSIDE}' WHEN 3 THEN '{T.OUTSIDE}' ELSE '{T.BAD_JSON}' END AS first FROM events")
def i10_parse_candidate_scope(spark, sf):
    return scoped(spark, sf).select("event_id", F.coalesce(T.first_error(F.col("shape"), F.col("allowed"), F.col("shown")), F.lit("")).alias("first"))


@_r.add(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{T.UNKNOWN}；{T.REPEATED}' WHEN 2 THEN '{T.OUTSIDE}' WHEN 3 THEN '{T.OUTSIDE}；{T.REPEATED}' ELSE '{T.BAD_JSON}' END AS every FROM events")
def i10_parse_all_errors(spark, sf):
    return scoped(spark, sf).select("event_id", F.array_join(T.parse_errors(F.col("shape"), F.col("allowed"), F.col("shown")), "；").alias("every"))


@_r.add(f"WITH {TRACES} SELECT user_id, block, (len(missing) = 0)::INT AS strict, (len(missing) < len(gold))::INT AS loose FROM m WHERE len(gold) > 0 AND len(pred) > 0")
def i18_semantic_rule(spark, sf):
    missing = F.size(A.minus(F.col("gold"), F.col("pred")))
    return traces(spark, sf).where((F.size("gold") > 0) & (F.size("pred") > 0)).select("user_id", "block", (missing == 0).cast("int").alias("strict"), (missing < F.size("gold")).cast("int").alias("loose"))


def _repeat():
    return lambda prompts: [f"{len(p)}:{p}" for p in prompts]


@_r.add("SELECT item_id, md5(length(text) || ':' || text) AS answer FROM benchmark")
def k01_generate(spark, sf):
    """The generation plug-in, with a model that repeats the prompt behind its length."""
    out = P.generate(read(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt")), _repeat)
    return out.select("item_id", md5(F.col("answer")).alias("answer"))


def _letters():
    return lambda texts: [[float(t.count(c)) for c in "abc"] for t in texts]


@_r.add("SELECT item_id, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a, (length(text) - length(replace(text, 'b', '')))::DOUBLE AS b FROM benchmark")
def i03_encode(spark, sf):
    """The encoder plug-in, with a model that counts letters."""
    out = P.encode(read(spark, sf, "benchmark").select("item_id", "text"), _letters)
    return out.select("item_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@_r.add("SELECT n_name AS tool, CASE n_nationkey % 3 WHEN 0 THEN 'name' ELSE 'description' END AS rule FROM nation WHERE n_nationkey % 3 < 2")
def m02_catalog_contract(spark, sf):
    k = F.col("n_nationkey") % 3
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("id"), F.when(k != 0, F.col("n_name")).alias("name"), F.when(k != 1, "x").otherwise(" ").alias("description"))
    return V.violations(rows, "id", {"name": ~X.is_blank(F.col("name")), "description": ~X.is_blank(F.col("description"))}).select(F.col("id").alias("tool"), "rule")


@_r.add(f"WITH {TRACES} SELECT 'differs: verdict' AS rule, user_id || '-' || block AS id FROM t WHERE gold = pred AND block % 3 = 0 UNION ALL SELECT 'not saved', user_id || '-' || block FROM t WHERE block % 3 = 1")
def m04_saved_predictions(spark, sf):
    """Saved verdicts against verdicts made again: some are spoilt, some missing."""
    fresh = traces(spark, sf).withColumn("id", key()).select("id", "block", T.verdict(F.col("gold"), F.col("pred")).alias("verdict"))
    saved = fresh.where("block % 3 <> 1").withColumn("verdict", F.when(F.col("block") % 3 == 0, T.WRONG).otherwise(F.col("verdict")))
    return V.compare(saved, fresh, "id", ["verdict"])


@_r.add(f"WITH {TRACES} SELECT array_to_string(cand, ',') AS query FROM t GROUP BY cand HAVING count(DISTINCT gold) > 1")
def m06_one_gold_per_query(spark, sf):
    rows = traces(spark, sf).select(text("cand").alias("query"), text("gold").alias("gold")).distinct()
    return V.unique(rows, ["query"], "one gold").select(F.col("id").alias("query"))


@_r.add(f"WITH {TRACES} SELECT x.tool FROM (SELECT DISTINCT event_type AS tool FROM events UNION ALL SELECT 'never') x WHERE x.tool NOT IN (SELECT unnest(gold) FROM t)")
def m07_uncovered_tools(spark, sf):
    every = read(spark, sf, "events").select(F.col("event_type").alias("tool")).distinct().union(spark.createDataFrame([("never",)], "tool string"))
    return every.join(traces(spark, sf).select(F.explode("gold").alias("tool")).distinct(), "tool", "left_anti")


@_r.add("SELECT 'gap' AS rule, event_id::VARCHAR AS id FROM events WHERE event_id % 100 = 51")
def m08_resume_integrity(spark, sf):
    return V.contiguous(read(spark, sf, "events").where("event_id % 100 <> 50").select(F.col("event_id").alias("id")), "id")


def streamed(spark, sf, name, sink, files=2, batches=4):
    """``sink`` over the events, written as files and read as a stream that stops and goes on again."""
    path, checkpoint = scratch(spark, f"{name}-in"), scratch(spark, f"{name}-offsets")
    events = read(spark, sf, "events").select("event_id", "event_type", "user_id")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(batches).write.mode("append").parquet(path)
        N.run_available(spark, path, events.schema, sink, checkpoint, files)


@_r.add("SELECT event_id, event_type FROM events")
def n01_micro_batches(spark, sf):
    out = scratch(spark, "n01-out")
    streamed(spark, sf, "n01", lambda df, _: df.select("event_id", "event_type").write.mode("append").parquet(out))
    return spark.read.parquet(out)


@_r.add("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def n03_resume_stream(spark, sf):
    """A run that stops half-way and goes on behind its checkpoint: no row is lost or counted twice, and counters come from what is written."""
    out = scratch(spark, "n03-out")
    streamed(spark, sf, "n03", lambda df, k: df.write.mode("append").parquet(out), 3)
    done = spark.read.parquet(out)
    left = N.pending(read(spark, sf, "events").select("event_id", "event_type", "user_id"), done, "event_id")
    return done.unionByName(left).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@_r.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def n04_running_counters(spark, sf):
    """Counters over all batches of a stream, in complete mode."""
    path, name = scratch(spark, "n04-in"), f"counters_{scratch(spark, 'x')[-8:]}"
    events = read(spark, sf, "events").select("event_id", "event_type")
    events.repartition(4).write.parquet(path)
    counts = N.running_counts(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path), "event_type")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "n04-offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


HARDNESS = "CASE WHEN len(spare) > 0 THEN 1 ELSE 0 END, len(spare), len(cand), (SELECT count(*) FROM (SELECT unnest(range(1, len(gold) + 1)) AS i) a, (SELECT unnest(range(1, len(gold) + 1)) AS j) b WHERE i < j AND list_position(shown, gold[i]) > list_position(shown, gold[j]))"
NATURAL = f"h AS (SELECT user_id, block, gold, pred, row({HARDNESS}) AS hard FROM (SELECT *, list_reverse(cand) AS shown FROM m) WHERE gold <> pred), nat AS (SELECT user_id, array_to_string(gold, ',') AS chosen, array_to_string(pred, ',') AS rejected FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hard DESC, md5(concat_ws('|', '42', 'natural', user_id || '-' || block)) DESC) = 1)"


def natural(spark, sf):
    w = traces(spark, sf).where("gold <> pred")
    return w.select(F.col("user_id").alias("query"), key().alias("id"), text("gold").alias("chosen"), text("pred").alias("rejected"), T.hardness(F.col("gold"), F.reverse("cand")).alias("hardness"))


@_r.add(f"WITH {TRACES}, {NATURAL} SELECT user_id AS query, chosen, rejected FROM nat")
def j15_dpo_natural(spark, sf):
    rows = natural(spark, sf)
    return B.preference_pairs(rows, rows, rows.select("query", "id", "chosen", "rejected").limit(0)).drop("source")


@_r.add(f"WITH {TRACES}, {NATURAL}, mk AS (SELECT user_id, array_to_string(gold, ',') AS chosen, array_to_string(list_concat(gold, ['none']), ',') AS rejected FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY user_id || '-' || block) = 1) SELECT user_id AS query, chosen, rejected, 'natural' AS source FROM nat WHERE user_id % 3 > 0 UNION ALL SELECT user_id, chosen, rejected, 'synthetic' FROM mk WHERE user_id % 3 = 0 OR user_id NOT IN (SELECT user_id FROM nat)")
def j17_dpo_assembly(spark, sf):
    every = traces(spark, sf).select(F.col("user_id").alias("query"), key().alias("id"), text("gold").alias("chosen"), text(F.concat("gold", F.array(F.lit("none")))).alias("rejected"))
    return B.preference_pairs(natural(spark, sf).where("query % 3 > 0"), every, every)
