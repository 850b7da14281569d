"""BM25 and dense retrieval, fusion, reranking, all-hit@k."""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inner_product, words
from . import every_pair as E
from . import scoring as S
from .relational import top

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
#: Query rows up to which the query side of a full scan is broadcast.
BROADCAST_QUERIES = 50_000


def postings(docs: DataFrame, id_col: str, text_col: str, tokens=words) -> DataFrame:
    """(doc, token, tf, dl): dl counts all tokens of the document."""
    listed = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    return listed.select("doc", "dl", F.explode("t").alias("token")).groupBy("doc", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, text_col: str, tokens=words) -> DataFrame:
    """(token, n, w), tokenising once: in how many documents a token occurs; the row without a token has the number of documents, and in w that of their tokens."""
    listed = docs.select(tokens(F.col(text_col)).alias("t"))
    none = F.lit(None).cast("string").alias("token")
    units = F.concat(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("token"), F.lit(0).alias("w"))), F.array(F.struct(none, F.size("t").alias("w"))))
    return listed.select(F.explode(units).alias("u")).groupBy("u.token").agg(F.count(F.lit(1)).alias("n"), F.sum("u.w").alias("w"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """One row from ``term_counts``: n documents, avgdl."""
    return counts.where("token is null").select("n", (F.col("w") / F.col("n")).alias("avgdl"))


def idf(counts: DataFrame) -> DataFrame:
    """(token, df, idf) from ``term_counts``; a negative idf becomes a quarter of the mean of all."""
    docs = F.broadcast(counts.where("token is null").select(F.col("n").alias("docs")))  # one row
    raw = counts.where("token is not null").select("token", F.col("n").alias("df")).crossJoin(docs)
    raw = raw.withColumn("raw", F.ln(F.col("docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, q_col: str, q_text: str, k: int, tokens=words) -> DataFrame:
    """(qid, item, score, rank): documents sharing a token with the query, best first; ties to the smaller id. Repeated query tokens
    count each time. Where the queries' tokens are few enough to be sent to all and ids are whole numbers, documents are scored where they are read;
    those that share an id or have none, and all other cases, are joined with the queries by token."""
    counts = term_counts(docs, text_col, tokens)
    asked = queries.select(F.col(q_col).alias("qid"), F.explode(tokens(F.col(q_text))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))
    few = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    whole = all(dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for df, c in ((docs, id_col), (queries, q_col)))
    if not few or not whole:
        scored = joined_scores(docs, asked, idf(counts), corpus_stats(counts).select("avgdl"), id_col, text_col, few, tokens)
    else:
        asked_rows = asked.where("qid is not null").collect()
        avgdl, weight = asked_weights(counts, {r.token for r in asked_rows})
        listed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        unclear = listed.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc is null").select("doc")
        known = [(r.qid, r.token, r.qtf * weight[r.token]) for r in asked_rows if r.token in weight]
        parts = []
        if odd := not unclear.isEmpty() or asked.where("qid is null").limit(1).count() > 0:
            stats = docs.sparkSession.createDataFrame([(avgdl,)], "avgdl double")
            weights = docs.sparkSession.createDataFrame(list(weight.items()), "token string, idf double")
            repeated = listed.join(unclear, listed["doc"].eqNullSafe(unclear["doc"]), "left_semi")
            parts = [joined_scores(repeated, asked, weights, stats, "doc", "text", True, tokens), joined_scores(listed.join(unclear, listed["doc"].eqNullSafe(unclear["doc"]), "left_anti"), asked.where("qid is null"), weights, stats, "doc", "text", True, tokens)]
            listed = listed.join(unclear, listed["doc"].eqNullSafe(unclear["doc"]), "left_anti")
        if known or not odd:
            found = S.best(listed.select(F.col("doc").cast("long"), tokens(F.col("text")).alias("t")), S.gathered(known), k, avgdl or 1.0, K1, B)
            parts.append(found.select("qid", "item", F.round("score", 9).alias("score")))
        scored = reduce(DataFrame.unionByName, parts)
    return top(scored, ["qid"], [F.desc("score"), F.col("item")], k)


def asked_weights(counts: DataFrame, wanted: set[str]) -> tuple[float | None, dict[str, float]]:
    """avgdl, and the idf (as by ``idf``) of the wanted tokens that occur, from one pass over ``term_counts``: what comes back is a row for each of them and one for each df that others have."""
    listed = counts.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "named string")
    # a condition on n stays above the sum, so all documents are read once
    total = F.when(F.col("n") > 0, F.col("token").isNull())
    rows = counts.withColumn("total", total).join(F.broadcast(listed), F.col("token") == F.col("named"), "left").groupBy("total", "named", "n").agg(F.count(F.lit(1)).alias("terms"), F.sum("w").alias("w")).collect()
    docs = next(((r.n, r.w) for r in rows if r.total), (0, 0))
    raw = lambda df: math.log(docs[0] - df + 0.5) - math.log(df + 0.5)
    terms = [r for r in rows if not r.total]
    mean = math.fsum(r.terms * raw(r.n) for r in terms) / (sum(r.terms for r in terms) or 1)
    return docs[1] / docs[0] if docs[0] else None, {r.named: EPSILON * mean if raw(r.n) < 0 else raw(r.n) for r in terms if r.named is not None}


def joined_scores(docs: DataFrame, asked: DataFrame, weights: DataFrame, stats: DataFrame, id_col: str, text_col: str, few: bool, tokens=words) -> DataFrame:
    """(qid, item, score), a row for each query and document that share a token, from ``asked`` (qid, token, qtf), weights (token, idf) and stats (avgdl; one row). Tokens that no query asks for
    are dropped before documents are shuffled, where the queries' are few enough to be sent to all."""
    wanted = asked.select("token").distinct()
    listed = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("t")).withColumn("dl", F.size("t")).select("doc", "dl", F.explode("t").alias("token"))
    posted = listed.join(F.broadcast(wanted) if few else wanted, "token", "left_semi").groupBy("doc", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    weighted = asked.join(weights, "token").crossJoin(F.broadcast(stats))
    hits = posted.join(F.broadcast(weighted) if few else weighted, "token")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", F.col("doc").alias("item")).agg(F.round(F.sum(part), 9).alias("score"))


def scored_pairs(queries: DataFrame, corpus: DataFrame, score: Column) -> DataFrame:
    """(qid, item, score), rounded to nine places, of queries (qid, q) against corpus (item, v), never a vector against itself."""
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    pairs = corpus.crossJoin(F.broadcast(queries) if small else queries).where("qid <> item")
    return pairs.select("qid", "item", F.round(score, 9).alias("score"))


def scored_cells(queries: DataFrame, corpus: DataFrame, function, schema: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """Queries (qid, q) against corpus (item, v) as by ``every_pair.cells``, and what this leaves out as ``scored_pairs``: vectors that are null, of another size than the others, or
    with components that are null, not finite or huge. They take no products, but their pairs count too."""
    asked, found = queries.where("qid is not null"), corpus.where("item is not null")
    (n_queries, least, most, odd), (n, low, high, odd_too) = E.measured(asked, "q"), E.measured(found, "v")
    score, size = inner_product(F.col("q"), F.col("v")), max(most or 0, high or 0)
    if not n_queries or not n or size <= 0:
        return None, [scored_pairs(asked, found, score)]
    q, v = E.regular(F.col("q"), size), E.regular(F.col("v"), size)
    ids = lambda rows, key, c: rows.select(F.col(key).cast("long").alias("id"), F.col(c).cast("array<double>").alias("v"))
    cells = E.cells(ids(asked.where(q), "qid", "q"), ids(found.where(v), "item", "v"), size, n_queries, n, function, schema)
    rest = [scored_pairs(asked.where(~q), found, score)] if odd or least < size else []
    return cells, rest + ([scored_pairs(asked.where(q), found.where(~v), score)] if odd_too or low < size else [])


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """(qid, item, score, rank) of queries (qid, q) against corpus (item, v), never a vector against itself; all are scored. Ids are whole numbers, unless ``score`` is given."""
    if score is not None:
        scored = scored_pairs(queries, corpus, score)
    else:
        cells, rest = scored_cells(queries, corpus, partial(E.best, k=k), "qid long, item long, score double")
        scored = reduce(DataFrame.unionByName, ([] if cells is None else [cells.withColumn("score", F.round("score", 9))]) + rest)
    return top(scored, ["qid"], [F.desc("score"), F.col("item")], k)


def dense_sums(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, n, total): how many vectors each of queries (qid, q) was scored against, of corpus (item, v) but its own, and the sum of the scores."""
    cells, rest = scored_cells(queries, corpus, E.sums, "qid long, n long, total double")
    parts = ([] if cells is None else [cells]) + [r.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")) for r in rest]
    return reduce(DataFrame.unionByName, parts).groupBy("qid").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_of_group(queries: DataFrame, items: DataFrame, group: str, k: int) -> DataFrame:
    """(qid, item, rank): for each of queries (qid, group) the k items of its group with the least ids, other than its own. Nothing but the k + 1 first ids of a group, up to k rows of each,
    meets the queries."""
    counts = items.where(F.col("item").isNotNull() & F.col(group).isNotNull()).groupBy(group, "item").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    first = top(counts, [group], [F.col("item")], k + 1).select(group, "item", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("time"))
    return top(queries.join(first, group).where("qid <> item").select("qid", "item"), ["qid"], [F.col("item")], k)


def minmax(c: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 0.0).otherwise((c - low) / (high - low))


def fuse(dense: DataFrame, sparse: DataFrame, method: str, k: int, w_dense: float = 0.5, w_sparse: float = 0.5) -> DataFrame:
    """Two ranked lists, cut at k, as one: ``union`` (order of first occurrence), ``weighted`` (min-max scores) or ``rrf``. (qid, item,
    score, rank); equal scores go by dense rank, then sparse rank."""
    d = dense.where(F.col("rank") <= k).select("qid", "item", F.col("rank").alias("d_rank"), minmax(F.col("score"), "qid").alias("d"))
    s = sparse.where(F.col("rank") <= k).select("qid", "item", F.col("rank").alias("s_rank"), minmax(F.col("score"), "qid").alias("s"))
    both = d.join(s, ["qid", "item"], "full_outer")
    if method == "union":
        score = F.lit(0.0)
    elif method == "weighted":
        score = F.round(w_dense * F.coalesce("d", F.lit(0.0)) + w_sparse * F.coalesce("s", F.lit(0.0)), 9)
    elif method == "rrf":
        score = F.round(F.coalesce(1 / (RRF + F.col("d_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("s_rank")), F.lit(0.0)), 9)
    else:
        raise ValueError(f"no such fusion: {method}")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"))
    return both.select("qid", "item", score.alias("score"), "d_rank", "s_rank").withColumn("rank", F.row_number().over(order)).select("qid", "item", "score", "rank")


def all_hit(ranked: DataFrame, gold: DataFrame, cutoffs: list[int], queries: DataFrame | None = None) -> DataFrame:
    """One row: total and the share of queries whose gold items all stand among the first k, for every k. ``gold`` is (qid, item)."""
    worst = gold.join(ranked.select("qid", "item", "rank"), ["qid", "item"], "left").groupBy("qid").agg(F.when(F.count_if(F.col("rank").isNull()) == 0, F.max("rank")).alias("worst"))
    return worst.agg(F.count(F.lit(1)).alias("total"), *[F.round(F.avg(F.coalesce(F.col("worst") <= k, F.lit(False)).cast("double")), 4).alias(f"all_hit_{k}") for k in cutoffs])


def all_hit_eligible(ranked: DataFrame, gold: DataFrame, cutoffs: list[int]) -> DataFrame:
    """As ``all_hit``, each k over the queries with at most k gold items."""
    worst = gold.join(ranked.select("qid", "item", "rank"), ["qid", "item"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.when(F.count_if(F.col("rank").isNull()) == 0, F.max("rank")).alias("worst"))
    hit = lambda k: F.count_if((F.col("n") <= k) & F.coalesce(F.col("worst") <= k, F.lit(False)))
    out = []
    for k in cutoffs:
        out += [F.count_if(F.col("n") <= k).alias(f"valid_{k}"), F.round(F.coalesce(F.try_divide(hit(k), F.count_if(F.col("n") <= k)), F.lit(0.0)), 4).alias(f"all_hit_{k}")]
    return worst.agg(*out)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def rerank(candidates: DataFrame, scorer=jaccard) -> DataFrame:
    """Candidates (qid, item, rank, query, passage) by the score of (query, passage), ties by their old rank; those without
    a passage are dropped. ``scorer`` takes two Columns, so a model's pandas UDF fits too."""
    scored = candidates.where("passage is not null").select("qid", "item", F.col("rank").alias("old_rank"), F.round(scorer(F.col("query"), F.col("passage")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "old_rank")))
