"""Retrieval: BM25 over documents, dense search and fusion over embeddings, reranking, all-hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import inner_product, l2_normalise, segmented
from ..operators import retrieval as R
from ..operators.relational import top, upsert
from ..sources.sinks import key_values, wide
from .registry import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
K = 15
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
BM25 = f"""
t AS (SELECT doc_id AS doc, {TOKENS.format('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
p AS (SELECT doc, len(t) AS dl, unnest(t) AS token FROM t),
post AS MATERIALIZED (SELECT doc, dl, token, count(*) AS tf FROM p GROUP BY ALL),
raw AS MATERIALIZED (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY token),
idf AS MATERIALIZED (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS qid, unnest({TOKENS.format('text')}) AS token FROM benchmark),
asked AS (SELECT qid, token, count(*) AS qtf FROM q GROUP BY ALL),
scored AS (SELECT qid, doc AS item, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM post JOIN asked USING (token) JOIN idf USING (token), stats GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM scored QUALIFY rank <= 15)
"""
#: Dense ranking by all 64 dimensions, and a second one by the first 32.
DENSE = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS item, round(list_dot_product(a.v, b.v), 9) AS full_score,
  round(list_dot_product(a.v[1:32], b.v[1:32]), 9) AS half_score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
d AS (SELECT qid, item, full_score AS score, row_number() OVER (PARTITION BY qid ORDER BY full_score DESC, item) AS rank FROM s QUALIFY rank <= 15),
h AS (SELECT qid, item, half_score AS score, row_number() OVER (PARTITION BY qid ORDER BY half_score DESC, item) AS rank FROM s QUALIFY rank <= 15)
"""
FUSED = (
    DENSE
    + """,
dn AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM d WINDOW w AS (PARTITION BY qid)),
hn AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM h WINDOW w AS (PARTITION BY qid)),
f AS (SELECT coalesce(dn.qid, hn.qid) AS qid, coalesce(dn.item, hn.item) AS item, dn.rank AS dr, hn.rank AS hr,
  round(0.5 * coalesce(dn.x, 0) + 0.5 * coalesce(hn.x, 0), 9) AS weighted, round(coalesce(1 / (60 + dn.rank), 0) + coalesce(1 / (60 + hn.rank), 0), 9) AS rrf
  FROM dn FULL JOIN hn ON dn.qid = hn.qid AND dn.item = hn.item)
"""
)


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def dense(spark, sf, size: int = 64, k: int = K):
    """The stated query set, ids divisible by 20, against all vectors."""
    v = vectors(spark, sf)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.slice("v", 1, size).alias("q"))
    return R.dense_topk(asked, v.select(F.col("vec_id").alias("item"), F.slice("v", 1, size).alias("v")), k)


def fused(spark, sf, method, k=K):
    return R.fuse(dense(spark, sf, k=k), dense(spark, sf, 32, k), method, k)


def bm25(spark, sf):
    return R.bm25_topk(read(spark, sf, "documents"), read(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", K)


def rounded(df, places=6):
    return df.withColumn("score", F.round("score", places))


@_r.add(f"WITH {BM25} SELECT qid, item, round(score, 6) AS score, rank FROM bm")
def i02_bm25_topk(spark, sf):
    return rounded(bm25(spark, sf))


@_r.add(f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS terms, (SELECT round(avg(idf), 6) FROM idf) AS mean_idf FROM stats")
def e19_bm25_corpus_stats(spark, sf):
    counts = R.term_counts(read(spark, sf, "documents"), "text")
    stats = R.corpus_stats(counts)
    weights = R.idf(counts).agg(F.count(F.lit(1)).alias("terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return stats.crossJoin(weights).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "mean_idf")


@_r.add(f"WITH {BM25} SELECT token, df, round(idf, 6) AS idf FROM idf")
def i01_bm25_idf(spark, sf):
    return R.idf(R.term_counts(read(spark, sf, "documents"), "text")).select("token", "df", F.round("idf", 6).alias("idf"))


@_r.add(f"WITH {BM25} SELECT token, sum(tf)::BIGINT AS tf, count(*) AS docs FROM post GROUP BY token")
def h36_tokenise(spark, sf):
    return R.postings(read(spark, sf, "documents"), "doc_id", "text").groupBy("token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("docs"))


HAN_TEXT = "CASE event_id % 3 WHEN 0 THEN '查询订单状态，谢谢' WHEN 1 THEN '我要退货退款订单' ELSE '订单' || event_type || '查库存abc' END"
DICTIONARY = ["查询", "订单", "订单状态", "退货", "退款", "库存", "谢谢"]
#: Segmentation by longest match, of the three texts above, worked out by hand; the event type stands for itself.
HAN_WORDS = "CASE event_id % 3 WHEN 0 THEN '查询|订单状态|谢谢' WHEN 1 THEN '我|要|退货|退款|订单' ELSE '订单|' || event_type || '|查|库存|abc' END"


@_r.add(f"SELECT event_id, {HAN_WORDS} AS words FROM events")
def h36_segment(spark, sf):
    return read(spark, sf, "events").select("event_id", F.array_join(segmented(F.expr(HAN_TEXT), DICTIONARY), "|").alias("words"))


@_r.add(f"WITH w AS (SELECT event_id, unnest(string_split({HAN_WORDS}, '|')) AS token FROM events) SELECT token, count(DISTINCT event_id) AS n FROM w GROUP BY token")
def i01_segmented_counts(spark, sf):
    docs = read(spark, sf, "events").select(F.expr(HAN_TEXT).alias("text"))
    return R.term_counts(docs, "text", lambda c: segmented(c, DICTIONARY)).where("token is not null").select("token", "n")


@_r.add(f"WITH {DENSE} SELECT qid, item, round(score, 6) AS score, rank FROM d")
def i05_dense_topk(spark, sf):
    return rounded(dense(spark, sf))


@_r.add(f"WITH {DENSE} SELECT qid, count(*) AS n, round(sum(full_score), 4) AS total FROM s GROUP BY qid")
def d08_cross_join_score(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    return R.dense_sums(asked, v.select(F.col("vec_id").alias("item"), "v")).select("qid", "n", F.round("total", 4).alias("total"))


@_r.add("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_dot_product(v, v), 6) AS square FROM v")
def h32_l2_normalise(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.round(F.element_at(l2_normalise(F.col("v")), 1), 6).alias("first"), F.round(inner_product(F.col("v"), F.col("v")), 6).alias("square"))


@_r.add(f"WITH {FUSED} SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY dr NULLS LAST, hr) AS rank FROM f")
def i06_hybrid_union(spark, sf):
    return fused(spark, sf, "union").drop("score")


@_r.add(f"WITH {FUSED} SELECT qid, item, round(weighted, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, dr NULLS LAST, hr NULLS LAST) AS rank FROM f")
def i07_hybrid_weighted(spark, sf):
    return rounded(fused(spark, sf, "weighted"), 4)


@_r.add(f"WITH {FUSED} SELECT qid, item, round(rrf, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dr NULLS LAST, hr NULLS LAST) AS rank FROM f")
def i08_hybrid_rrf(spark, sf):
    return rounded(fused(spark, sf, "rrf"))


@_r.add(f"WITH {FUSED.replace('rank <= 15', 'rank <= 10')} SELECT qid, item, rank FROM (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, dr NULLS LAST, hr NULLS LAST) AS rank FROM f) WHERE rank <= 10")
def i09_candidates(spark, sf):
    return fused(spark, sf, "weighted", 10).where("rank <= 10").drop("score")


@_r.add(f"WITH {DENSE} SELECT qid, " + ", ".join(f"max(item) FILTER (rank = {i}) AS candidate_{i}" for i in range(1, 11)) + " FROM d GROUP BY qid")
def b09_candidates_wide(spark, sf):
    return wide(dense(spark, sf), 10)


GOLD = "gold AS (SELECT qid, item FROM (SELECT a.vec_id AS qid, b.vec_id AS item, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rn <= 1 + qid % 4)"
#: Gold items: the first items of the query's label, one to four of them.


def gold(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    return R.first_of_group(asked, v.select(F.col("vec_id").alias("item"), "label"), "label", 4).where("rank <= 1 + qid % 4").drop("rank")


HITS = "worst AS (SELECT qid, count(*) AS n, CASE WHEN count(*) FILTER (rank IS NULL) = 0 THEN max(rank) END AS worst FROM gold LEFT JOIN d USING (qid, item) GROUP BY qid)"


@_r.add(f"WITH {DENSE}, {GOLD}, {HITS} SELECT count(*) AS total, " + ", ".join(f"round(avg(coalesce(worst <= {k}, false)::INT), 4) AS all_hit_{k}" for k in (5, 8, 10, 12, 15)) + " FROM worst")
def e03_all_hit_at_k(spark, sf):
    return R.all_hit(dense(spark, sf), gold(spark, sf), [5, 8, 10, 12, 15])


@_r.add(f"WITH {DENSE}, {GOLD}, {HITS} SELECT " + ", ".join(f"count(*) FILTER (n <= {k}) AS valid_{k}, round(coalesce(count(*) FILTER (n <= {k} AND coalesce(worst <= {k}, false)) / nullif(count(*) FILTER (n <= {k}), 0), 0.0), 4) AS all_hit_{k}" for k in (3, 4, 5)) + " FROM worst")
def e04_all_hit_eligible_at_k(spark, sf):
    return R.all_hit_eligible(dense(spark, sf), gold(spark, sf), [3, 4, 5])


@_r.add(
    f"WITH {FUSED}, {GOLD}, u AS (SELECT method, qid, item, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, dr NULLS LAST, hr NULLS LAST) AS rank FROM (SELECT 'rrf' AS method, qid, item, rrf AS score, dr, hr FROM f UNION ALL SELECT 'weighted', qid, item, weighted, dr, hr FROM f UNION ALL SELECT 'union', qid, item, 0, dr, hr FROM f)), "
    "w AS (SELECT method, qid, CASE WHEN count(*) FILTER (rank IS NULL) = 0 THEN max(rank) END AS worst FROM (SELECT m.method, g.qid, u.rank FROM gold g CROSS JOIN (SELECT DISTINCT method FROM u) m LEFT JOIN u ON u.method = m.method AND u.qid = g.qid AND u.item = g.item) GROUP BY ALL) "
    "SELECT method, count(*) AS total, round(avg(coalesce(worst <= 5, false)::INT), 4) AS all_hit_5, round(avg(coalesce(worst <= 15, false)::INT), 4) AS all_hit_15 FROM w GROUP BY method"
)
def i15_fusion_grid(spark, sf):
    d, h, g = dense(spark, sf), dense(spark, sf, 32), gold(spark, sf)
    out = [R.all_hit(R.fuse(d, h, m, K), g, [5, 15]).select(F.lit(m).alias("method"), "total", "all_hit_5", "all_hit_15") for m in ("union", "weighted", "rrf")]
    return out[0].unionByName(out[1]).unionByName(out[2])


RERANK = (
    "r AS (SELECT bm.qid, bm.item, bm.rank AS old_rank, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 9) AS score "
    f"FROM bm JOIN (SELECT item_id, list_distinct({TOKENS.format('text')}) AS w FROM benchmark) a ON a.item_id = bm.qid JOIN (SELECT doc_id, list_distinct({TOKENS.format('text')}) AS w FROM documents) b ON b.doc_id = bm.item)"
)


def few_queries(asked, rows: int = 1) -> bool:
    """Whether so many rows for each query can be sent to all."""
    most = R.BROADCAST_QUERIES // rows
    return asked.limit(most + 1).count() <= most


def reranked(spark, sf):
    docs, asked = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    candidates = bm25(spark, sf).select("qid", "item", "rank").join(asked.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), "qid")
    passages = docs.select(F.col("doc_id").alias("item"), F.col("text").alias("passage"))
    # candidates are a few for each query, so texts needn't be shuffled; without one, a candidate is dropped
    return R.rerank(passages.join(F.broadcast(candidates) if few_queries(asked, K) else candidates, "item"))


@_r.add(f"WITH {BM25}, {RERANK} SELECT qid, item, old_rank, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS rank FROM r")
def i13_rerank_lexical(spark, sf):
    return rounded(reranked(spark, sf))


CONTAINS = "gold AS (SELECT item_id AS qid, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@_r.add(f"WITH {BM25}, {RERANK}, {CONTAINS}, k AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old_rank) AS rank FROM r), w AS (SELECT qid, count(*) AS n, CASE WHEN count(*) FILTER (rank IS NULL) = 0 THEN max(rank) END AS worst FROM gold LEFT JOIN k USING (qid, item) GROUP BY qid) SELECT " + ", ".join(f"count(*) FILTER (n <= {k}) AS valid_{k}, round(coalesce(count(*) FILTER (n <= {k} AND coalesce(worst <= {k}, false)) / nullif(count(*) FILTER (n <= {k}), 0), 0.0), 4) AS all_hit_{k}" for k in (3, 4, 5)) + " FROM w")
def i14_rerank_summary(spark, sf):
    docs, asked = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    small = few_queries(asked)  # the benchmark is the small, fixed side: its size is checked
    passages = asked.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    found = docs.join(F.broadcast(passages) if small else passages, F.contains("text", "passage")).select("qid", F.col("doc_id").alias("item"))
    return R.all_hit_eligible(reranked(spark, sf), found, [3, 4, 5])


@_r.add("SELECT 'a' AS model, 3 AS seq, 0.75::DOUBLE AS hit UNION ALL SELECT 'b', 1, 0.25 UNION ALL SELECT 'c', 4, 0.1")
def b07_summary_upsert(spark, sf):
    old = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.25)], "model string, seq int, hit double")
    new = spark.createDataFrame([("a", 2, 0.6), ("a", 3, 0.75), ("c", 4, 0.1)], "model string, seq int, hit double")
    return upsert(old, new, ["model"])


@_r.add(f"WITH {FUSED} SELECT qid, item, round(x, 6) AS score FROM dn")
def h29_minmax_normalise(spark, sf):
    return dense(spark, sf).select("qid", "item", F.round(R.minmax(F.col("score"), "qid"), 6).alias("score"))


@_r.add(f"WITH {FUSED} SELECT qid, count(*) AS items, count(dr) AS dense, count(hr) AS half, count(*) FILTER (dr IS NOT NULL AND hr IS NOT NULL) AS both FROM f GROUP BY qid")
def d09_full_outer_fuse(spark, sf):
    d, h = dense(spark, sf).select("qid", "item", F.col("rank").alias("dr")), dense(spark, sf, 32).select("qid", "item", F.col("rank").alias("hr"))
    return d.join(h, ["qid", "item"], "full_outer").groupBy("qid").agg(F.count(F.lit(1)).alias("items"), F.count("dr").alias("dense"), F.count("hr").alias("half"), F.count_if(F.col("dr").isNotNull() & F.col("hr").isNotNull()).alias("both"))


@_r.add(f"WITH {DENSE} SELECT qid, item, round(sum(score), 5) AS score FROM (SELECT qid, item, score FROM d UNION ALL SELECT qid, item, score FROM h) GROUP BY ALL")
def e17_score_sum(spark, sf):
    both = dense(spark, sf).unionByName(dense(spark, sf, 32))
    return both.groupBy("qid", "item").agg(F.round(F.sum("score"), 5).alias("score"))


@_r.add(f"WITH {DENSE}, u AS (SELECT qid, item, 0 AS src, rank FROM d UNION ALL SELECT qid, item, 1, rank FROM h), o AS (SELECT qid, item, src, rank, row_number() OVER (PARTITION BY qid, item ORDER BY src, rank) AS n FROM u) SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY src, rank) AS pos FROM o WHERE n = 1")
def f04_ordered_union(spark, sf):
    both = dense(spark, sf).withColumn("src", F.lit(0)).unionByName(dense(spark, sf, 32).withColumn("src", F.lit(1)))
    first = top(both.withColumnRenamed("rank", "at"), ["qid", "item"], [F.col("src"), F.col("at")], 1, "n")
    return top(first, ["qid"], [F.col("src"), F.col("at")], 1 << 30, "pos").select("qid", "item", "pos")


@_r.add(f"WITH {DENSE} SELECT k, count(*) AS kept, round(avg(score), 6) AS mean FROM d JOIN (SELECT unnest([5, 8, 10, 12, 15]) AS k) ON rank <= k GROUP BY k")
def g01_topk_slice(spark, sf):
    cut = dense(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (5, 8, 10, 12, 15))))).where("rank <= k")
    return cut.groupBy("k").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("score"), 6).alias("mean"))


@_r.add(f"WITH {DENSE} SELECT metric, round(value, 6) AS value FROM (SELECT 'mean' AS metric, avg(score) AS value FROM d UNION ALL SELECT 'best', max(score) FROM d UNION ALL SELECT 'rows', count(*) FROM d)")
def b05_metrics_unpivot(spark, sf):
    one = dense(spark, sf).agg(F.avg("score").alias("mean"), F.max("score").alias("best"), F.count(F.lit(1)).alias("rows"))
    return key_values(one).withColumn("value", F.round("value", 6))
