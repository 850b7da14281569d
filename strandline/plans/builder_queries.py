"""Builders of training sets over chains: the nations of an order's suppliers are its gold tools, regions are flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import builders as B
from ..operators import validate as V
from .registry import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
PER_TOOL, PARTIAL, HARD = 20, 1200, 300
#: Suppliers that are sent to all lines.
SUPPLIERS = 2_000_000


def seeded_sql(purpose: str, *key: str) -> str:
    return f"md5(concat_ws('|', '42', '{purpose}', {', '.join(f'{k}::VARCHAR' for k in key)}))"


def order_sql(a: str, purpose: str, key: str) -> str:
    return f"list_transform(list_sort(list_transform({a}, lambda x: {{'h': {seeded_sql(purpose, key, 'x')}, 't': x}})), lambda s: s.t)"


def number_sql(purpose: str, key: str) -> str:
    return f"('0x' || substr({seeded_sql(purpose, key)}, 1, 7))::BIGINT"


def minus_sql(a: str, b: str) -> str:
    return f"list_filter({a}, lambda y: NOT list_contains({b}, y))"


CHAINS = """
g AS (SELECT l_orderkey AS id, n_name AS tool, min(l_linenumber) AS pos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
chain AS (SELECT id, list(tool ORDER BY pos, tool) AS gold FROM g GROUP BY id),
tools AS (SELECT n_nationkey AS place, n_name AS tool, r_name AS flow, n_name || ' in ' || r_name AS description FROM nation JOIN region ON r_regionkey = n_regionkey),
cat AS (SELECT list(tool ORDER BY place) AS names, list({'t': tool, 'c': flow} ORDER BY place) AS pairs FROM tools),
pools AS (SELECT a.tool, any_value(a.flow) AS flow, list(b.tool ORDER BY b.tool) AS pool FROM tools a JOIN tools b ON a.flow = b.flow AND a.tool <> b.tool GROUP BY a.tool)
"""


def catalog(spark, sf):
    region = read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("category"))
    return read(spark, sf, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("tool"), "category", F.concat("n_name", F.lit(" in "), "category").alias("description"))


def pools(spark, sf):
    """tool, pool: the other tools of a tool's flow, sorted; a row for each tool."""
    c = catalog(spark, sf).select("tool", "category")
    other = c.select("category", F.col("tool").alias("other"))
    return c.join(other, "category").where("tool <> other").groupBy("tool").agg(F.array_sort(F.collect_list("other")).alias("pool"))


def chains(spark, sf):
    """id, gold: the tools of an order by their first line. Lines are shuffled once, by order; suppliers are sent to them if they are few."""
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("tool"))
    suppliers = read(spark, sf, "supplier")
    few_suppliers = suppliers.limit(SUPPLIERS + 1).count() <= SUPPLIERS
    supplier = suppliers.join(F.broadcast(nation), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "tool")
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey", F.col("l_linenumber").alias("pos"))
    lines = lines.join(F.broadcast(supplier) if few_suppliers else supplier, "l_suppkey")
    ordered = F.sort_array(F.collect_list(F.struct(F.isnull("pos").alias("last"), "pos", "tool")))
    return lines.groupBy("id").agg(F.array_distinct(F.transform(ordered, lambda s: s["tool"])).alias("gold"))


def text(c):
    return F.array_join(c, ",")


IN_CATEGORIES = "list_transform(list_filter(pairs, lambda p: list_contains({0}, p.c) AND NOT list_contains(gold, p.t)), lambda p: p.t)"
CATEGORIES = "list_transform(list_filter(pairs, lambda q: list_contains({0}, q.t)), lambda q: q.c)"
NEGATIVES = f"""
{CHAINS},
m AS (SELECT id, gold, CASE WHEN len(gold) = 1 THEN 'single' WHEN row_number() OVER (PARTITION BY len(gold) = 1 ORDER BY id) <= {PARTIAL} THEN 'multi_partial' ELSE 'multi_random' END AS mode, names, pairs, {minus_sql('names', 'gold')} AS spare FROM chain, cat),
s1 AS (SELECT id, gold, spare, pairs, {IN_CATEGORIES.format(CATEGORIES.format('gold[1:1]'))} AS same FROM m WHERE mode = 'single'),
s2 AS (SELECT *, list_concat({order_sql('same', 'same', 'id')}[1:1], {order_sql(minus_sql('spare', 'same'), 'cross', 'id')}[1:1]) AS found FROM s1),
s3 AS (SELECT id, 'single' AS mode, gold, list_concat(found, {order_sql(minus_sql('spare', 'found'), 'fill', 'id')})[1:2] AS neg FROM s2),
p1 AS (SELECT *, greatest(1, len(gold) // 2) AS k, {order_sql('gold', 'keep', 'id')}[1:greatest(1, len(gold) // 2)] AS kept FROM m WHERE mode = 'multi_partial'),
p2 AS (SELECT *, {IN_CATEGORIES.format(CATEGORIES.format(minus_sql('gold', 'kept')))} AS related FROM p1),
p3 AS (SELECT *, {order_sql('CASE WHEN len(related) > 0 THEN related ELSE spare END', 'replace', 'id')}[1:len(gold) - k] AS replaced FROM p2),
p4 AS (SELECT id, mode, gold, list_concat(list_concat(kept, replaced), {order_sql(minus_sql('spare', 'replaced'), 'fill', 'id')})[1:3] AS neg FROM p3),
r1 AS (SELECT id, mode, gold, {order_sql('spare', 'random', 'id')}[1:3] AS neg FROM m WHERE mode = 'multi_random'),
every AS (SELECT * FROM s3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM r1)
"""


def negatives(spark, sf, mode):
    rows = chains(spark, sf)
    if mode == "single":
        rows = rows.where(F.size("gold") == 1)
    else:
        many = rows.where(F.size("gold") > 1)
        first = many.select("id").orderBy("id").limit(PARTIAL)
        rows = many.join(first, "id", "left_semi" if mode == "multi_partial" else "left_anti")
    found = rows.crossJoin(F.broadcast(B.catalog_row(catalog(spark, sf)))).withColumn("found", B.hard_negatives(F.col("gold"), mode, 42, F.col("id")))
    return found.select("id", text("gold").alias("gold"), text("found").alias("negatives"))


def _negatives_sql(mode):
    return f"WITH {NEGATIVES} SELECT id, array_to_string(gold, ',') AS gold, array_to_string(neg, ',') AS negatives FROM every WHERE mode = '{mode}'"


@_r.add(_negatives_sql("single"))
def j08_negatives_single(spark, sf):
    return negatives(spark, sf, "single")


@_r.add(_negatives_sql("multi_partial"))
def j09_negatives_multi_partial(spark, sf):
    return negatives(spark, sf, "multi_partial")


@_r.add(_negatives_sql("multi_random"))
def j10_negatives_multi_random(spark, sf):
    return negatives(spark, sf, "multi_random")


@_r.add(f"WITH {NEGATIVES}, d AS (SELECT map(list(tool), list(description)) AS d FROM tools) SELECT id, mode, array_to_string(list_transform(gold, lambda t: d[t]), '|') AS pos, array_to_string(list_transform(neg, lambda t: d[t]), '|') AS neg FROM every, d")
def j19_hard_negative_rows(spark, sf):
    rows = B.hard_negative_rows(chains(spark, sf), catalog(spark, sf), PARTIAL)
    return rows.select("id", "mode", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


SINGLE = f"""
{CHAINS},
rec AS (SELECT c_custkey AS question, n_name AS tool FROM customer JOIN nation ON n_nationkey = c_nationkey),
cnt AS (SELECT tool, count(*) AS n FROM rec GROUP BY tool),
rnd AS (SELECT question, tool, pool, unnest(range(1, CASE WHEN n >= {PER_TOOL} THEN 1 ELSE 2 * ceil({PER_TOOL} / n)::INT + 8 END + 1)) AS round FROM rec JOIN cnt USING (tool) JOIN pools USING (tool)),
kk AS (SELECT *, question || '-' || round AS k FROM rnd),
sh AS (SELECT question, tool, round, {order_sql(f"list_concat([tool], {order_sql('pool', 'draw', 'k')}[1:1 + {number_sql('count', 'k')} % least(4, len(pool))])", 'show', 'k')} AS shown FROM kk),
dd AS (SELECT question, tool, shown, min(round) AS round FROM sh GROUP BY ALL),
single AS (SELECT question, tool, round, shown FROM dd QUALIFY row_number() OVER (PARTITION BY tool ORDER BY round, {seeded_sql('single', "question || '-' || round")}) <= {PER_TOOL})
"""


def single(spark, sf):
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tool"))
    records = read(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey").select(F.col("c_custkey").alias("question"), "tool")
    return B.single_samples(records, pools(spark, sf), PER_TOOL)


@_r.add(f"WITH {SINGLE} SELECT question, tool, round, array_to_string(shown, ',') AS shown FROM single")
def j11_sft_single(spark, sf):
    return single(spark, sf).withColumn("shown", text("shown"))


SHUFFLED = """
WITH RECURSIVE p(n, a) AS (SELECT n, []::BIGINT[] FROM range(2, 6) t(n) UNION ALL SELECT p.n, list_append(a, i) FROM p, range(1, 6) r(i) WHERE i <= n AND NOT list_contains(a, i) AND len(a) < n),
perm AS (SELECT n, list(a) AS orders FROM p WHERE len(a) = n AND a <> range(1, n + 1) GROUP BY n), """ + CHAINS + f""",
few AS (SELECT id, gold FROM chain WHERE len(gold) BETWEEN 2 AND 5),
un AS (SELECT id, gold, {order_sql("list_transform(orders, lambda o: array_to_string(list_transform(o, lambda i: gold[i]), ','))", 'permutation', 'id')} AS unused FROM few JOIN perm ON n = len(gold)),
e AS (SELECT id, unnest(unused[1:3]) AS shown, unnest(range(1, 4)[1:len(unused[1:3])]) AS round FROM un),
shuffled AS (SELECT id, round, shown FROM e QUALIFY row_number() OVER (ORDER BY round, {seeded_sql('shuffled', 'id', 'round')}) <= (SELECT count(*) * 3 // 2 FROM few))
"""


def few(spark, sf):
    return chains(spark, sf).where(F.size("gold").between(2, 5))


def shuffled(spark, sf):
    return B.multi_shuffle_samples(few(spark, sf), lambda n: n * 3 // 2)


@_r.add(f"{SHUFFLED} SELECT id, len(unused) AS orders, unused[1] AS first FROM un")
def h27_permutation_table(spark, sf):
    rows = few(spark, sf).join(F.broadcast(B.permutation_table(spark)), F.size("gold") == F.col("n"))
    unused = B.unused_orders(F.col("gold"), F.col("orders"), 42, F.col("id"), 120)
    return rows.select("id", unused.alias("unused")).select("id", F.size("unused").cast("long").alias("orders"), F.col("unused")[0].alias("first"))


@_r.add(f"{SHUFFLED} SELECT id, round, shown FROM shuffled")
def j12_sft_multi_shuffle(spark, sf):
    return shuffled(spark, sf).select("id", F.col("round").cast("long").alias("round"), "shown")


HARDS = f"""
{CHAINS},
el AS (SELECT id, gold, {minus_sql('pool', 'gold')} AS pool FROM chain JOIN pools ON pools.tool = gold[1]),
rm AS (SELECT *, least(3, 5 - len(gold), len(pool)) AS room FROM el WHERE least(3, 5 - len(gold), len(pool)) >= 1),
dr AS (SELECT * FROM rm QUALIFY row_number() OVER (ORDER BY {seeded_sql('hard sample', 'id')}) <= {HARD}),
hard AS (SELECT id, gold, {order_sql(f"list_concat(gold, {order_sql('pool', 'hard draw', 'id')}[1:1 + {number_sql('hard count', 'id')} % room])", 'hard show', 'id')} AS shown FROM dr)
"""


def hard(spark, sf):
    p = pools(spark, sf).select(F.col("tool").alias("head"), "pool")
    return B.multi_hard_samples(chains(spark, sf).withColumn("head", F.element_at("gold", 1)).join(F.broadcast(p), "head").select("id", "gold", "pool"), HARD)


@_r.add(f"WITH {HARDS} SELECT id, array_to_string(gold, ',') AS gold, array_to_string(shown, ',') AS shown FROM hard")
def j13_sft_multi_hard(spark, sf):
    return hard(spark, sf).select("id", text("gold").alias("gold"), text("shown").alias("shown"))


def built(spark, sf):
    """kind, id, gold, shown of all samples of the three builders."""
    one = single(spark, sf).select(F.lit("single").alias("kind"), F.concat_ws("-", "question", "round").alias("id"), F.array("tool").alias("gold"), "shown")
    two = shuffled(spark, sf).select(F.lit("multi_shuffle").alias("kind"), F.concat_ws("-", "id", "round").alias("id"), "gold", F.split("shown", ",").alias("shown"))
    three = hard(spark, sf).select(F.lit("multi_hard").alias("kind"), F.col("id").cast("string").alias("id"), "gold", "shown")
    return one.unionByName(two).unionByName(three)


def _rest(sql: str) -> str:
    """The parts of a WITH clause behind the chains, which all builders share."""
    return sql.split(CHAINS, 1)[1].lstrip().lstrip(",")


BUILT = f"{SHUFFLED}, {_rest(SINGLE)}, {_rest(HARDS)}, built AS (SELECT 'single' AS kind, question || '-' || round AS id, [tool] AS gold, shown FROM single UNION ALL SELECT 'multi_shuffle', id || '-' || round, gold, string_split(shown, ',') FROM shuffled JOIN few USING (id) UNION ALL SELECT 'multi_hard', id::VARCHAR, gold, shown FROM hard)"


@_r.add(f"{BUILT} SELECT kind, count(*) AS generated, round(avg(len(shown)), 6) AS candidates, min(len(shown)) AS fewest, max(len(shown)) AS most, sum(len(shown) - len(gold))::BIGINT AS distractors, count(*) FILTER (len(gold) = 1) AS gold_1, count(*) FILTER (len(gold) = 2) AS gold_2, count(*) FILTER (len(gold) > 2) AS gold_more, CASE kind WHEN 'single' THEN {PER_TOOL} * (SELECT count(*) FROM tools) WHEN 'multi_hard' THEN {HARD} ELSE (SELECT count(*) * 3 // 2 FROM few) END AS target FROM built GROUP BY kind")
def e20_build_report(spark, sf):
    n = F.size("gold")
    targets = catalog(spark, sf).agg((PER_TOOL * F.count(F.lit(1))).alias("target")).select(F.lit("single").alias("kind"), "target")
    targets = targets.union(few(spark, sf).agg((F.floor(F.count(F.lit(1)) * 3 / 2)).alias("target")).select(F.lit("multi_shuffle").alias("kind"), "target"))
    targets = targets.union(spark.range(1).select(F.lit("multi_hard").alias("kind"), F.lit(HARD).cast("long")))
    size = F.size("shown").cast("long")
    report = built(spark, sf).groupBy("kind").agg(
        F.count(F.lit(1)).alias("generated"), F.round(F.avg(size), 6).alias("candidates"), F.min(size).alias("fewest"), F.max(size).alias("most"), F.sum(size - n).alias("distractors"),
        F.count_if(n == 1).alias("gold_1"), F.count_if(n == 2).alias("gold_2"), F.count_if(n > 2).alias("gold_more"),
    )
    return report.join(F.broadcast(targets), "kind")


@_r.add(
    f"{BUILT}, bad AS (SELECT *, kind || ':' || id AS k, CASE ascii(right(id, 1)) % 5 WHEN 0 THEN shown[1:len(shown) - 1] WHEN 1 THEN list_concat(shown, shown[1:1]) WHEN 2 THEN gold ELSE shown END AS seen FROM built) "
    "SELECT rule, k AS id FROM (SELECT 'two to five candidates' AS rule, k FROM bad WHERE len(seen) NOT BETWEEN 2 AND 5 UNION ALL SELECT 'candidates differ', k FROM bad WHERE len(seen) <> len(list_distinct(seen)) UNION ALL SELECT 'gold is shown', k FROM bad WHERE NOT list_has_all(seen, gold) "
    "UNION ALL SELECT 'known tools', k FROM bad, cat WHERE NOT list_has_all(names, seen) UNION ALL SELECT 'of its kind', k FROM bad WHERE NOT CASE kind WHEN 'single' THEN len(gold) = 1 AND len(seen) > 1 WHEN 'multi_shuffle' THEN list_sort(seen) = list_sort(gold) AND seen <> gold ELSE len(seen) > len(gold) END)"
)
def m03_validation_samples(spark, sf):
    """The contract of built samples, on samples some of which are broken on purpose."""
    rows, seen, gold = built(spark, sf).withColumn("k", F.concat_ws(":", "kind", "id")), F.col("seen"), F.col("gold")
    turn = F.ascii(F.right("id", F.lit(1))) % 5
    shown = F.when(turn == 0, F.slice("shown", 1, F.size("shown") - 1)).when(turn == 1, F.concat("shown", F.slice("shown", 1, 1))).when(turn == 2, gold).otherwise(F.col("shown"))
    names = F.broadcast(catalog(spark, sf).agg(F.collect_set("tool").alias("names")))  # one row
    kinds = F.when(F.col("kind") == "single", (F.size(gold) == 1) & (F.size(seen) > 1)).when(F.col("kind") == "multi_shuffle", (F.array_sort(seen) == F.array_sort(gold)) & (seen != gold)).otherwise(F.size(seen) > F.size(gold))
    rules = {"two to five candidates": F.size(seen).between(2, 5), "candidates differ": A.is_unique(seen), "gold is shown": A.subset(gold, seen), "known tools": A.subset(seen, F.col("names")), "of its kind": kinds}
    return V.violations(rows.withColumn("seen", shown).crossJoin(names), "k", rules)


@_r.add(f"WITH {CHAINS}, f AS (SELECT DISTINCT flow FROM tools), hit AS (SELECT id, f.flow FROM chain, f WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(gold) AS x) u WHERE u.x NOT IN (SELECT tool FROM tools t WHERE t.flow = f.flow))), b AS (SELECT *, flow <> (SELECT max(flow) FROM f) AS regular FROM hit) SELECT id, CASE WHEN count(*) FILTER (regular) = 1 THEN min(flow) FILTER (regular) WHEN count(*) FILTER (regular) = 0 THEN min(flow) END AS flow, count(*) FILTER (regular) > 1 AS ambiguous FROM b GROUP BY id")
def d10_flow_classify(spark, sf):
    """The flow whose pool holds all gold tools: the only regular one, else the complex one (here the last by name); several regular ones are an error."""
    pools_ = catalog(spark, sf).groupBy(F.col("category").alias("flow")).agg(F.collect_set("tool").alias("pool"))
    flows = F.broadcast(pools_.withColumn("regular", F.col("flow") != F.max("flow").over(Window.partitionBy(F.lit(0)))))  # a row for each flow
    hit = chains(spark, sf).join(flows, F.size(F.array_except("gold", "pool")) == 0)
    regular = F.count_if("regular")
    return hit.groupBy("id").agg(F.when(regular == 1, F.min(F.when(F.col("regular"), F.col("flow")))).when(regular == 0, F.min("flow")).alias("flow"), (regular > 1).alias("ambiguous"))
