"""Scans, scalars, joins, quotas, samples and contracts over the remaining tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as Q
from ..operators import validate as V
from ..operators.builders import first_n, numbered, seeded_order
from ..sources.jsonl import parse
from ..sources.sinks import as_json
from .registry import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
md5 = lambda purpose, key: f"md5(concat_ws('|', '42', '{purpose}', {key}::VARCHAR))"
PRED = "CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END"
CM = f"cm AS (SELECT count(*) FILTER (quality = 1 AND {PRED} = 1) AS tp, count(*) FILTER (quality <> 1 AND {PRED} = 1) AS fp, count(*) FILTER (quality = 1 AND {PRED} <> 1) AS fn, count(*) FILTER (quality <> 1 AND {PRED} <> 1) AS tn FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("pred"))
    return read(spark, sf, "labels").join(docs, "doc_id")


def counts(spark, sf):
    return labelled(spark, sf).agg(*Q.confusion(F.col("quality"), F.col("pred"), 1))


@_r.add(f"WITH {CM} SELECT * FROM cm")
def e01_confusion_counts(spark, sf):
    return counts(spark, sf)


@_r.add(f"WITH {CM} SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm")
def e02_classification_metrics(spark, sf):
    return Q.classification_metrics(counts(spark, sf))


@_r.add(f"SELECT doc_id, CASE WHEN quality = 1 AND {PRED} = 1 THEN 'TP' WHEN quality = 1 THEN 'FN' WHEN {PRED} = 1 THEN 'FP' ELSE 'TN' END AS kind FROM labels l JOIN documents d USING (doc_id)")
def i17_sample_kind(spark, sf):
    g, p = F.col("quality") == 1, F.col("pred") == 1
    return labelled(spark, sf).select("doc_id", F.when(g & p, "TP").when(g, "FN").when(p, "FP").otherwise("TN").alias("kind"))


@_r.add("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def b16_count_table(spark, sf):
    return read(spark, sf, "labels").cube("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@_r.add("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def c04_tp_filter(spark, sf):
    return read(spark, sf, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


@_r.add("SELECT doc_id FROM labels WHERE nullif(quality, 1) = 0")
def c05_null_aware_zero_filter(spark, sf):
    return read(spark, sf, "labels").where(F.nullif("quality", F.lit(1)) == 0).select("doc_id")


@_r.add("SELECT p_partkey, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def c06_allow_list_filter(spark, sf):
    return read(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23")).select("p_partkey", "p_type")


@_r.add("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def c13_limit_by_id(spark, sf):
    return read(spark, sf, "events").orderBy("event_id").limit(100).select("event_id", "user_id")


WORDS = {"omission": ("the", "ohne"), "extra": ("!!", "|"), "semantic": ("stupid", "scum")}


@_r.add("SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f") AS {k}" for k, ws in WORDS.items()) + " FROM documents")
def i16_error_reason_labels(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *[X.contains_any(F.col("text"), ws).alias(k) for k, ws in WORDS.items()])


@_r.add("WITH l AS (SELECT unnest([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in WORDS.items()) + "]) AS label FROM documents) SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label")
def e07_error_label_counts(spark, sf):
    labels = F.array_compact(F.array(*[F.when(X.contains_any(F.col("text"), ws), k) for k, ws in WORDS.items()]))
    return read(spark, sf, "documents").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


BRANDS = "b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)"
REMAINDER = f"{BRANDS}, x AS (SELECT *, n * 1000 / (SELECT sum(n) FROM b) AS e FROM b), y AS (SELECT *, floor(e) AS w, round(e - floor(e), 9) AS f FROM x), q AS (SELECT p_brand, n, (w + CASE WHEN row_number() OVER (ORDER BY f DESC, p_brand) <= 1000 - (SELECT sum(w) FROM y) THEN 1 ELSE 0 END)::BIGINT AS quota FROM y)"


def brands(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@_r.add(f"WITH {BRANDS} SELECT p_brand, n, (333 // (SELECT count(*) FROM b) + CASE WHEN row_number() OVER (ORDER BY p_brand) <= 333 % (SELECT count(*) FROM b) THEN 1 ELSE 0 END)::BIGINT AS quota FROM b")
def j01_group_quota_equal(spark, sf):
    return Q.equal_quota(brands(spark, sf), "p_brand", 333)


@_r.add(f"WITH {REMAINDER} SELECT p_brand, n, quota FROM q")
def j02_quota_largest_remainder(spark, sf):
    return Q.largest_remainder(brands(spark, sf), "p_brand", "n", 1000)


@_r.add(f"WITH {REMAINDER.replace('1000', 'round_even((SELECT sum(n) FROM b) * 0.2, 0)')} SELECT p_brand, n, quota FROM q")
def j03_quota_split(spark, sf):
    b = brands(spark, sf)
    total = b.agg(F.bround(F.sum("n") * 0.2, 0).cast("long").alias("__total"))
    return Q.largest_remainder(b.crossJoin(F.broadcast(total)), "p_brand", "n", F.col("__total")).drop("__total")


@_r.add(f"WITH {REMAINDER} SELECT p_partkey, part.p_brand FROM part JOIN q USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {md5('sample', 'p_partkey')}, p_partkey) <= quota")
def j05_stratified_sample(spark, sf):
    quotas = Q.largest_remainder(brands(spark, sf), "p_brand", "n", 1000)
    return Q.sample_by_quota(read(spark, sf, "part"), quotas, "p_brand", "p_partkey", 42).select("p_partkey", "p_brand")


@_r.add(f"SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY {md5('split', 'c_custkey')}, c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) THEN 'holdout' ELSE 'train' END AS split FROM customer")
def j06_train_test_split(spark, sf):
    w = Window.partitionBy("c_mktsegment")
    rn = F.row_number().over(w.orderBy(X.seeded(42, "split", F.col("c_custkey")), "c_custkey"))
    return read(spark, sf, "customer").select("c_custkey", F.when(rn <= F.floor(F.count(F.lit(1)).over(w) * 0.2), "holdout").otherwise("train").alias("split"))


@_r.add(f"SELECT p_partkey FROM part ORDER BY {md5('exact', 'p_partkey')}, p_partkey LIMIT 200")
def j04_sample_exact(spark, sf):
    return read(spark, sf, "part").orderBy(X.seeded(42, "exact", F.col("p_partkey")), "p_partkey").limit(200).select("p_partkey")


@_r.add(f"SELECT o_orderkey, {md5('shuffle', 'o_orderkey')} AS place FROM orders ORDER BY place, o_orderkey")
def g10_seeded_shuffle(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", X.seeded(42, "shuffle", F.col("o_orderkey")).alias("place")).orderBy("place", "o_orderkey")


@_r.add("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def f05_dedup_keep_first(spark, sf):
    return read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@_r.add("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def f05_dedup_keep_last(spark, sf):
    return Q.keep(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", "o_orderkey")


@_r.add("SELECT count(*) AS total, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def g04_row_dedup_count(spark, sf):
    return read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("text").alias("kept")).withColumn("duplicates", F.col("total") - F.col("kept"))


@_r.add("SELECT 'label' AS src, doc_id AS id FROM labels UNION ALL SELECT 'document', doc_id FROM documents")
def g05_union_all_sources(spark, sf):
    one = lambda t, n: read(spark, sf, t).select(F.lit(n).alias("src"), F.col("doc_id").alias("id"))
    return one("labels", "label").unionByName(one("documents", "document"))


@_r.add("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def g07_intersect_ids(spark, sf):
    return read(spark, sf, "documents").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id"))


@_r.add("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def g08_id_except(spark, sf):
    return read(spark, sf, "documents").select("doc_id").subtract(read(spark, sf, "labels").select("doc_id"))


@_r.add("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_documents, count(*) FILTER (d.doc_id IS NULL) AS only_labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def g09_key_symmetric_diff(spark, sf):
    d, l = read(spark, sf, "documents").select(F.col("doc_id").alias("d")), read(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    return d.join(l, F.col("d") == F.col("l"), "full_outer").agg(F.count_if(F.col("l").isNull()).alias("only_documents"), F.count_if(F.col("d").isNull()).alias("only_labels"))


@_r.add("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def d06_semi_tp(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@_r.add("SELECT l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def d01_inner_drop_unmatched(spark, sf):
    return read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id").select("doc_id", "lang")


@_r.add("WITH a AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) FILTER (a.n > 1) AS left_repeated, count(*) FILTER (b.n > 1) AS right_repeated, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS extra FROM a FULL JOIN b ON a.k = b.k")
def d02_checked_one_to_one_join(spark, sf):
    return Q.checked_join(read(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), read(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k")[1]


@_r.add("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def d03_description_lookup_skip(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return read(spark, sf, "lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@_r.add("SELECT count(*) AS n, count(p_partkey) AS known FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def d04_description_lookup_required(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("k"))
    return read(spark, sf, "lineitem").join(part, "l_partkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("known"))


@_r.add("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey >= 0")
def d05_index_lookup(spark, sf):
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, sf, "supplier").where("s_nationkey >= 0").join(nation, "s_nationkey").select("s_suppkey", "n_name")


@_r.add("SELECT o_orderkey AS id, CASE WHEN o_totalprice IS DISTINCT FROM round(o_totalprice) THEN 'differs: o_totalprice' END AS rule FROM orders WHERE o_totalprice IS DISTINCT FROM round(o_totalprice)")
def d07_positional_compare(spark, sf):
    saved = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    found = V.compare(saved, saved.withColumn("o_totalprice", F.round("o_totalprice")), "o_orderkey", ["o_totalprice"])
    return found.select(F.col("id").cast("long").alias("id"), "rule")


FLOW = "n AS (SELECT r_name AS flow, n_name AS tool FROM nation JOIN region ON r_regionkey = n_regionkey)"


def flows(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("flow"))
    return read(spark, sf, "nation").join(r, "n_regionkey").select("flow", F.col("n_name").alias("tool"))


@_r.add(f"WITH {FLOW} SELECT flow, string_agg(DISTINCT tool, ',' ORDER BY tool) AS pool FROM n GROUP BY flow")
def e15_flow_pool(spark, sf):
    return flows(spark, sf).groupBy("flow").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("pool"))


@_r.add(f"WITH {FLOW} SELECT a.tool, string_agg(DISTINCT b.tool, ',' ORDER BY b.tool) AS pool FROM n a JOIN n b ON a.flow = b.flow AND a.tool <> b.tool GROUP BY a.tool")
def d11_distractor_pool(spark, sf):
    n = flows(spark, sf)
    other = n.select("flow", F.col("tool").alias("other"))
    return n.join(other, "flow").where("tool <> other").groupBy("tool").agg(F.array_join(F.sort_array(F.collect_set("other")), ",").alias("pool"))


#: Parts that one task draws negatives for.
NEGATIVE_ROWS = 200_000
NEG = "p AS (SELECT p_partkey, p_brand FROM part), b AS (SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part)"


@_r.add(f"WITH b AS (SELECT DISTINCT p_brand AS brand FROM part) SELECT p_partkey, brand AS negative, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(concat_ws('|', '42', 'negative', p_partkey::VARCHAR, brand)), brand) AS n FROM part JOIN b ON brand <> p_brand QUALIFY n <= 3")
def j07_negatives_random(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_brand")
    every = part.agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))  # the catalog, one row
    # a row's own first three suffice; a key's rows are brought together before they become three
    dealt = part.repartition(max(8, -(-part.count() // NEGATIVE_ROWS)), "p_partkey").crossJoin(F.broadcast(every))
    first = first_n(seeded_order(F.array_remove("brands", F.col("p_brand")), 42, "negative", F.col("p_partkey")), 3)
    rows = dealt.select("p_partkey", F.explode(first).alias("negative"))
    return Q.top(rows, ["p_partkey"], [X.seeded(42, "negative", F.col("p_partkey"), F.col("negative")), F.col("negative")], 3, "n")


@_r.add(f"WITH {FLOW} SELECT a.tool, CASE WHEN a.flow = b.flow THEN 'same' ELSE 'other' END AS kind, b.tool AS negative FROM n a JOIN n b ON a.tool <> b.tool QUALIFY row_number() OVER (PARTITION BY a.tool, a.flow = b.flow ORDER BY md5(concat_ws('|', '42', 'hard', a.tool, b.tool)), b.tool) = 1")
def j08_negatives_hard(spark, sf):
    n = flows(spark, sf)
    every = n.agg(F.collect_set(F.struct("flow", "tool")).alias("every"))  # the catalog, one row
    rows = n.crossJoin(F.broadcast(every)).select("tool", "flow", F.explode("every").alias("o")).where("tool <> o.tool")
    rows = rows.select("tool", F.when(F.col("flow") == F.col("o.flow"), "same").otherwise("other").alias("kind"), F.col("o.tool").alias("negative"))
    return Q.top(rows, ["tool", "kind"], [X.seeded(42, "hard", F.col("tool"), F.col("negative")), F.col("negative")], 1).drop("rank")


@_r.add(f"WITH {FLOW} SELECT flow, count(*) - 1 AS negatives FROM n GROUP BY flow HAVING count(*) - 1 >= 3")
def c12_negatives_min3(spark, sf):
    return flows(spark, sf).groupBy("flow").agg((F.count(F.lit(1)) - 1).alias("negatives")).where("negatives >= 3")


@_r.add("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 1200 THEN 'partial' ELSE 'random' END AS mode FROM part")
def f07_position_mode_switch(spark, sf):
    part = read(spark, sf, "part").select("p_partkey")
    first = part.orderBy("p_partkey").limit(1200).withColumn("f", F.lit(1))
    return part.join(first, "p_partkey", "left").select("p_partkey", F.when(F.col("f") == 1, "partial").otherwise("random").alias("mode"))


@_r.add("SELECT p_brand, 1000 // count(*) AS per, (ceil(1000 / count(*) / 10.0))::BIGINT AS rounds, 1000 % count(*) AS rest, factorial(count(*)::INT % 6)::BIGINT AS f FROM part GROUP BY p_brand")
def j18_generation_plan(spark, sf):
    n = F.col("n")
    return brands(spark, sf).select("p_brand", F.expr("1000 div n").alias("per"), F.ceil(1000 / n / 10.0).alias("rounds"), (1000 % n).alias("rest"), F.factorial((n % 6).cast("int")).alias("f"))


@_r.add("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[,，;；\\s]+'), lambda x: x <> '')) AS n, md5(array_to_string(list_filter(regexp_split_to_array(text, '[,，;；\\s]+'), lambda x: x <> ''), '，')) AS joined FROM documents")
def h07_keyword_normalise(spark, sf):
    k = X.split_keywords(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(k).cast("long").alias("n"), F.md5(X.join_keywords(k).cast("binary")).alias("joined"))


@_r.add("SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM pages")
def h04_strip_tags(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("text"))


@_r.add("SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations")
def h02_fence_strip(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.remove_fences(fenced).cast("binary")).alias("text"))


@_r.add("SELECT conv_id, turn, md5(translate(text, ',:', ';.')) AS text FROM conversations")
def h05_punct_repair(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.translate("text", ",:", ";.").cast("binary")).alias("text"))


@_r.add("SELECT conv_id, coalesce(string_agg('tool_' || turn, ',' ORDER BY turn) FILTER (role = 'user'), '') AS tools FROM conversations GROUP BY conv_id")
def h12_block_extract(spark, sf):
    line = F.when(F.col("role") == "user", F.struct("turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(". 工具名：tool_"), F.col("turn").cast("string")).alias("x")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["x"]), "\n")
    prompts = read(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.lit("前言\n【候选工具】\n"), listed, F.lit("\n【用户问题】\n9. 工具名：no")).alias("prompt"))
    return prompts.select("conv_id", F.array_join(X.candidate_tools(F.col("prompt")), ",").alias("tools"))


@_r.add("SELECT doc_id, coalesce(nullif(CASE WHEN n_chars % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS v FROM documents")
def c02_truthy_coalesce(spark, sf):
    a = F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", X.truthy(a, F.col("source"), F.lit("")).alias("v"))


@_r.add("SELECT conv_id, turn, md5('[' || role || '] {' || text || '}') AS prompt FROM conversations")
def h13_prompt_render(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.render("[{role}] {{{text}}}", role=F.col("role"), text=F.col("text")).cast("binary")).alias("prompt"))


@_r.add("WITH q AS (SELECT *, (row_number() OVER (ORDER BY item_id) - 1) AS i FROM benchmark) SELECT i // 10 AS batch, md5(string_agg((i % 10 + 1)::VARCHAR || '. ' || text, chr(10) ORDER BY i)) AS listed FROM q GROUP BY 1")
def h15_batch_numbered_list(spark, sf):
    q = numbered(read(spark, sf, "benchmark").select("item_id", "text"), "item_id").select("text", (F.col("n") - 1).alias("i"))
    one = F.struct("i", F.concat((F.col("i") % 10 + 1).cast("string"), F.lit(". "), F.col("text")).alias("x"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), "\n")
    return q.groupBy(F.floor(F.col("i") / 10).cast("long").alias("batch")).agg(F.md5(listed.cast("binary")).alias("listed"))


@_r.add("SELECT p_brand, md5(string_agg(i || '. 工具名：' || p_name || chr(10) || '基本描述：' || p_type || chr(10) || '详细说明：', chr(10) || chr(10) ORDER BY p_partkey)) AS block FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) GROUP BY p_brand")
def h14_tool_catalog_render(spark, sf):
    tool = F.struct("p_partkey", F.col("p_name").alias("tool_name"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("enhanced_description"))
    return read(spark, sf, "part").groupBy("p_brand").agg(F.md5(X.render_catalog(F.array_sort(F.collect_list(tool))).cast("binary")).alias("block"))


@_r.add("SELECT event_id, CASE WHEN (props::JSON ->> 'k')::DOUBLE >= 1 THEN 1 ELSE 0 END AS flag, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def h34_binary_normalise(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", X.binary(k).cast("int").alias("flag"), k.cast("long").alias("k"))


@_r.add("SELECT o_orderpriority, round(sum(o_totalprice) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 2) AS per, count(*) FILTER (o_orderstatus = '?') AS none, NULL::DOUBLE AS empty_null, 0.0::DOUBLE AS empty_zero FROM orders GROUP BY o_orderpriority")
def h33_safe_divide(spark, sf):
    none = F.count_if(F.col("o_orderstatus") == "?")
    total = F.sum("o_totalprice")
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.round(X.safe_divide(total, F.count_if(F.col("o_orderstatus") == "F")), 2).alias("per"), none.alias("none"), X.safe_divide(total, none).alias("empty_null"), X.safe_divide(total, none, 0.0).alias("empty_zero")
    )


@_r.add("SELECT o_orderkey, round(o_totalprice, 1) AS up, floor(o_totalprice)::BIGINT AS low, ceil(o_totalprice)::BIGINT AS high FROM orders")
def h30_rounding_policy(spark, sf):
    p = F.col("o_totalprice")
    return read(spark, sf, "orders").select("o_orderkey", F.round(p, 1).alias("up"), F.floor(p).alias("low"), F.ceil(p).alias("high"))


@_r.add("SELECT count(*) AS rows, count(*) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') AS filled FROM conversations")
def e18_count_nonblank(spark, sf):
    return read(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~X.is_blank(F.col("text"))).alias("filled"))


def broken_lines(spark, sf):
    """Labels as JSON lines, some of them broken by their id."""
    good = as_json(read(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "quality", "toxic")
    k = F.get_json_object("value", "$.doc_id").cast("long")
    rows = good.select(k.alias("id"), "value")
    line = F.when(F.col("id") % 5 == 0, F.concat("value", F.lit(" zzz"))).when(F.col("id") % 7 == 0, F.lit("  ")).otherwise(F.col("value"))
    return rows.select("id", line.alias("line"))


@_r.add("SELECT doc_id AS id, quality FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def a03_scan_dropmalformed(spark, sf):
    good, _ = parse(broken_lines(spark, sf), "doc_id long, quality int, toxic int", "skip")
    return good.select("id", F.col("value.quality").alias("quality"))


@_r.add("SELECT doc_id AS id FROM labels WHERE doc_id % 5 = 0")
def b10_quarantine(spark, sf):
    return parse(broken_lines(spark, sf), "doc_id long", "quarantine")[1].select("id")


@_r.add("SELECT doc_id AS id, CASE WHEN toxic = 1 THEN '1' ELSE '0' END AS tools FROM labels WHERE doc_id % 2 = 0")
def a04_scan_labelled_lenient(spark, sf):
    rows = read(spark, sf, "labels")
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("doc_id").alias("q"), F.when(F.col("doc_id") % 4 == 0, F.col("toxic").cast("string")).alias("s"), F.when(F.col("doc_id") % 4 != 0, F.array(F.col("toxic").cast("string"))).alias("a")))).otherwise("{}")
    good, _ = parse(rows.select(F.col("doc_id").alias("id"), line.alias("line")), "q long, s string, a array<string>", "skip")
    from ..functions.arrays import as_list

    return good.select("id", F.array_join(as_list(F.col("value.s"), F.col("value.a")), ",").alias("tools"), "value").where("value.q is not null").drop("value")


@_r.add("SELECT source AS query, max_by(doc_id, doc_id) AS last, count(*) AS n FROM documents GROUP BY source")
def a17_gold_last_wins(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("source").alias("query")).agg(F.max_by("doc_id", "doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


@_r.add("SELECT rule, id FROM (SELECT 'discount' AS rule, l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE NOT (l_discount < 0.1) UNION ALL SELECT 'quantity', l_orderkey || '-' || l_linenumber FROM lineitem WHERE NOT (l_quantity < 49) UNION ALL SELECT 'flag', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')")
def m01_validation_violations(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return V.violations(rows, "key", {"discount": F.col("l_discount") < 0.1, "quantity": F.col("l_quantity") < 49, "flag": ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))})


@_r.add("SELECT 'unique' AS rule, o_custkey::VARCHAR AS id FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def m05_unique_keys(spark, sf):
    return V.unique(read(spark, sf, "orders"), ["o_custkey"], "unique")


