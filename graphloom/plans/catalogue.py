"""The queries of the engine's own operators over the driver's tables, and their SQL, by name.

The tables hold no programs, so operators are run on inputs of the same shape: ``dv`` (delayable values), ``tree``
and ``fg`` (graphs without and with cycles), ``wl`` (weighted links), ``seq`` (statements in blocks).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.operators import graph as G
from graphloom.operators.links import merge_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries from given starts, from all starts; SQL is too slow for these, so they have none.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def also_whole(f):
    """Registers f(spark, sf_dir, whole=True), from all starts, as NAME_whole."""
    name = next(k for k, v in QUERIES.items() if v is f)
    WHOLE[f"{name}_whole"] = partial(f, whole=True)
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# shapes -------------------------------------------------------------------------------------------------------

DV = """dv AS (SELECT l_suppkey AS g, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_orderkey % 97 = 0 THEN -1
  ELSE CAST(l_quantity AS INTEGER) % 6 + 8 * ((l_linenumber - 1) % 3) END AS v FROM lineitem)"""
TREE = "tree AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 0)"
FG = "fg AS (SELECT c_custkey AS src, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS dst FROM customer)"
WL = """wl AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, min(least(l_linenumber - 1, 4)) AS w FROM lineitem
  WHERE l_returnflag <> 'R' GROUP BY ALL)"""


def dv(spark, d):
    li = t(spark, d, "lineitem")
    delayed = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 97 == 0)
    v = F.when(delayed, F.lit(-1)).otherwise(F.col("l_quantity").cast("int") % 6 + (F.col("l_linenumber") - 1) % 3 * 8)
    return li.select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_linenumber", v.alias("v"))


def tree(spark, d):
    return t(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst"))


def fg(spark, d):
    c = t(spark, d, "customer")
    n = c.count()
    return c.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * F.col("c_custkey") + 1) % n).alias("dst"))


def wl(spark, d):
    li = t(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.min(F.least(F.col("l_linenumber") - 1, F.lit(4))).alias("w"))


def seq(spark, d):
    return t(spark, d, "conversations").select(F.col("conv_id").alias("block"), F.col("turn").alias("pos"), F.col("role").alias("kind"), F.length("text").alias("size"))


# lattice aggregates -------------------------------------------------------------------------------------------

def _aggregate(name: str, reduce, sql: str) -> None:
    query(name, f"WITH {DV} SELECT g, {sql} AS v FROM dv GROUP BY g")(lambda spark, d: dv(spark, d).groupBy("g").agg(reduce(F.col("v")).alias("v")))


_aggregate("q01_dv_min", L.least, "min(v)")
_aggregate("q02_dv_max", L.most, "CASE WHEN min(v) = -1 THEN -1 ELSE max(v) END")
_aggregate("q03_dv_max_ignore_delay", L.most_ignoring_delay, "max(v)")
_aggregate("q04_dv_min_ignore_not_involved", L.least_involved, "coalesce(min(nullif(v, 0)), 0)")
_aggregate("q05_dv_property_max", lambda v: L.most_or_best(v, 13), "CASE WHEN max(v) = 13 THEN 13 WHEN min(v) = -1 THEN -1 ELSE max(v) END")


@query("q06_dv_context_modified", f"WITH {DV}, m AS (SELECT l_orderkey AS g, CASE WHEN v = -1 THEN -1 ELSE v % 2 END AS v FROM dv) SELECT g, CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = -1 THEN -1 ELSE 0 END AS v FROM m GROUP BY g")
def q06(spark, d):
    bits = dv(spark, d).select(F.col("l_orderkey").alias("g"), F.when(F.col("v") == -1, F.col("v")).otherwise(F.col("v") % 2).alias("v"))
    return bits.groupBy("g").agg(L.context_modified(F.col("v")).alias("v"))


@query("q06b_dv_context_container", f"WITH {DV}, m AS (SELECT l_orderkey AS g, CASE WHEN v = -1 THEN -1 WHEN v % 8 = 5 THEN 5 ELSE 1 END AS v FROM dv) SELECT g, CASE WHEN max(v) = 5 THEN 5 WHEN min(v) = -1 THEN -1 ELSE 1 END AS v FROM m GROUP BY g")
def q06b(spark, d):
    values = dv(spark, d).select(F.col("l_orderkey").alias("g"), F.when(F.col("v") == -1, F.col("v")).when(F.col("v") % 8 == 5, F.lit(5)).otherwise(F.lit(1)).alias("v"))
    return values.groupBy("g").agg(L.context_container(F.col("v")).alias("v"))


@query("q07_dv_decode", f"WITH {DV} SELECT v, CASE WHEN v < 0 THEN 0 ELSE v & 7 END AS effective, CASE WHEN v < 0 THEN -1 ELSE v >> 3 END AS level, count(*) AS n FROM dv GROUP BY ALL")
def q07(spark, d):
    return dv(spark, d).select("v", L.effective(F.col("v")).alias("effective"), L.level(F.col("v")).alias("level")).groupBy("v", "effective", "level").agg(F.count(F.lit(1)).alias("n"))


@query("q08_dv_replace_delay", f"WITH {DV} SELECT g, sum(CASE WHEN v = -1 THEN 5 ELSE v END) AS total FROM dv GROUP BY g")
def q08(spark, d):
    return dv(spark, d).groupBy("g").agg(F.sum(L.replace_delay(F.col("v"), 5)).alias("total"))


@query(
    "q09_dv_causes_top",
    f"WITH {DV}, c AS (SELECT g, l_orderkey % 7 AS cause, l_linenumber AS place, l_orderkey AS stmt, v >= 16 AS high FROM dv), m AS (SELECT g, max(high) AS high FROM c GROUP BY g) SELECT g, cause, place, min(stmt) AS stmt FROM c JOIN m USING (g, high) GROUP BY ALL",
)
def q09(spark, d):
    causes = dv(spark, d).select("g", (F.col("l_orderkey") % 7).alias("cause"), F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("stmt"), (F.col("v") >= 16).alias("high"))
    return L.merge_causes(causes, ["g"])


@query("q10_dv_status", f"WITH {DV} SELECT g, count(*) FILTER (v <> -1) AS n_done, count(*) FILTER (v = -1) AS n_delayed, CASE WHEN count(*) FILTER (v = -1) = 0 THEN 'done' WHEN count(*) FILTER (v <> -1) > 0 THEN 'progress' ELSE 'delayed' END AS status FROM dv GROUP BY g")
def q10(spark, d):
    return dv(spark, d).groupBy("g").agg(*L.status(F.col("v")))


# scalar expressions -------------------------------------------------------------------------------------------

@query("q11_arith_fold", "SELECT p_partkey, p_size + 3 AS plus, p_size * 3 - p_size AS times, (p_size * 7) // 4 AS quotient, (p_size * 7) % 4 AS remainder, -p_size AS minus FROM part")
def q11(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", (s + 3).alias("plus"), (s * 3 - s).alias("times"), F.expr("int((p_size * 7) div 4)").alias("quotient"), (s * 7 % 4).alias("remainder"), (-s).alias("minus"))


@query("q12_bits", "SELECT p_partkey, p_size & 12 AS b_and, p_size | 3 AS b_or, xor(p_size, 21) AS b_xor, p_size << 3 AS b_left, p_size >> 2 AS b_right, p_size >> 1 AS b_unsigned, ~p_size AS b_not FROM part")
def q12(spark, d):
    s = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", s.bitwiseAND(F.lit(12)).alias("b_and"), s.bitwiseOR(F.lit(3)).alias("b_or"), s.bitwiseXOR(F.lit(21)).alias("b_xor"), F.shiftleft(s, 3).alias("b_left"), F.shiftright(s, 2).alias("b_right"), F.shiftrightunsigned(s, 1).alias("b_unsigned"), F.bitwise_not(s).alias("b_not"))


@query("q13_strings", "SELECT p_partkey, p_brand || '/' || p_type AS joined, length(p_name) AS n, CAST(p_size AS VARCHAR) AS as_text, p_brand IS NOT DISTINCT FROM p_type AS same FROM part")
def q13(spark, d):
    return t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.length("p_name").alias("n"), F.col("p_size").cast("string").alias("as_text"), F.col("p_brand").eqNullSafe(F.col("p_type")).alias("same"))


@query("q14_cond_simplify", "SELECT p_partkey, (p_size > 25 OR p_retailprice > 1000) AS either, (p_size > 25 AND p_retailprice > 1000) AS both_, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS same FROM part")
def q14(spark, d):
    x, b = F.col("p_size") > 25, F.col("p_retailprice") > 1000
    return t(spark, d, "part").select("p_partkey", F.when(x, F.lit(True)).otherwise(b).alias("either"), F.when(x, b).otherwise(F.lit(False)).alias("both_"), F.when(~x, F.lit(0)).otherwise(F.lit(1)).alias("same"))


@query("q15_interval_and", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 200000 AND o_totalprice >= 50000")
def q15(spark, d):
    from graphloom.functions.symbolic import filter_of

    # the contradiction of the second filter is seen before any row is read
    orders = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    kept = filter_of(orders, "o_totalprice>=1000 && o_totalprice<=200000 && o_totalprice>=50000")
    none = filter_of(orders, "o_totalprice>=10 && o_totalprice<=4")
    return kept.union(none).select("o_orderkey")


@query("q16_instanceof_like", """WITH RECURSIVE s(sub, super) AS (
  SELECT DISTINCT p_type, split_part(p_type, ' ', 1) FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1), 'ANY' FROM part),
c(sub, super) AS (SELECT sub, super FROM s UNION SELECT c.sub, s.super FROM c JOIN s ON c.super = s.sub)
SELECT super, count(*) AS n FROM c JOIN part ON p_type = sub WHERE sub <> super GROUP BY super""")
def q16(spark, d):
    part = t(spark, d, "part").select("p_type")
    head = F.split_part("p_type", F.lit(" "), F.lit(1))
    direct = part.select(F.col("p_type").alias("src"), head.alias("dst")).union(part.select(head.alias("src"), F.lit("ANY").alias("dst"))).distinct()
    up = G.supertypes(direct).where("type <> super")
    return part.groupBy("p_type").count().join(up, F.col("p_type") == F.col("type")).groupBy("super").agg(F.sum("count").alias("n"))


# sets, sorts, merges ------------------------------------------------------------------------------------------

@query("q17_union_distinct", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 40 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def q17(spark, d):
    return t(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("k")).union(t(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey")).distinct()


@query("q18_intersect_sets", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20")
def q18(spark, d):
    return t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(t(spark, d, "part").where("p_size > 20").select("p_partkey"))


@query("q19_except_sets", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def q19(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(t(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("q20_histogram_top20", f"WITH {DV} SELECT g, v, count(*) AS n FROM dv GROUP BY ALL ORDER BY n DESC, g, v LIMIT 20")
def q20(spark, d):
    return dv(spark, d).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g", "v").limit(20)


@query("q21_annotation_csv", "SELECT 'part:' || p_partkey AS fqn, string_agg(DISTINCT lower(l_returnflag || l_linestatus) || '-m', ',' ORDER BY lower(l_returnflag || l_linestatus) || '-m') AS annotations FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def q21(spark, d):
    from graphloom.sources.sinks import annotation_csv

    rows = t(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("fqn"), F.lit("method").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("annotation"))
    return annotation_csv(rows.join(t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("fqn")), "fqn", "left_semi"))


@query("q22_map_merge_full_outer", f"""WITH {DV}, a AS (SELECT g * 3 AS k, max(v) AS v FROM dv GROUP BY g), b AS (SELECT l_partkey AS k, min(l_linenumber) AS v FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v WHEN a.v = -1 OR b.v = -1 THEN -1 ELSE greatest(a.v, b.v) END AS v FROM a FULL JOIN b USING (k)""")
def q22(spark, d):
    a = dv(spark, d).groupBy((F.col("g") * 3).alias("k")).agg(F.max("v").alias("v"))
    b = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_linenumber").alias("v"))
    return L.merge_outer(a, b, ["k"])


_MERGE_SQL = "CASE op WHEN 'min' THEN min(v) WHEN 'max' THEN CASE WHEN min(v) = -1 THEN -1 ELSE max(v) END WHEN 'min_involved' THEN coalesce(min(nullif(v, 0)), 0) WHEN 'context_modified' THEN CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = -1 THEN -1 ELSE 0 END WHEN 'context_container' THEN CASE WHEN max(v) = 5 THEN 5 WHEN min(v) = -1 THEN -1 ELSE 1 END END"


@query("q23_merge_ops_table", f"WITH {DV}, ops(i, property, op) AS (VALUES " + ", ".join(f"({i}, '{p}', '{op}')" for i, (p, op, _) in enumerate(L.MERGE_OPS)) + f") SELECT g, property, {_MERGE_SQL} AS v FROM dv JOIN ops ON i = l_orderkey % {len(L.MERGE_OPS)} GROUP BY g, property, op")
def q23(spark, d):
    names = F.array(*(F.lit(p) for p, _, _ in L.MERGE_OPS))
    rows = dv(spark, d).select("g", F.get(names, (F.col("l_orderkey") % len(L.MERGE_OPS)).cast("int")).alias("property"), "v")
    return L.merge_by_op(rows, L.merge_ops(spark), ["g"])


# graphs -------------------------------------------------------------------------------------------------------

@query("q24_closure_tree", f"WITH RECURSIVE {TREE}, c(start, node) AS (SELECT src, src FROM tree UNION SELECT start, dst FROM c JOIN tree ON node = src) SELECT start, node FROM c UNION SELECT dst, dst FROM tree")
def q24(spark, d):
    return G.closure(tree(spark, d))


@query("q25_closure_cyclic", f"WITH RECURSIVE {FG}, c(start, node) AS (SELECT src, dst FROM fg UNION SELECT start, dst FROM c JOIN fg ON node = src) SELECT start, node FROM c")
def q25(spark, d):
    edges = fg(spark, d)
    return G.closure(edges, edges.select("src"), include_start=False)


@query("q26_topo_layers", f"WITH RECURSIVE {TREE}, l(node, layer) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT src, layer + 1 FROM l JOIN tree ON node = dst) SELECT node, layer, 'free' AS how FROM l")
def q26(spark, d):
    return G.layers(tree(spark, d))


@query("q27_on_cycle", f"WITH RECURSIVE {FG}, c(start, node) AS (SELECT src, dst FROM fg UNION SELECT start, dst FROM c JOIN fg ON node = src), m AS (SELECT a.start, min(a.node) AS cycle FROM c a JOIN c b ON a.start = b.node AND a.node = b.start GROUP BY 1), n AS (SELECT src AS node FROM fg UNION SELECT dst FROM fg) SELECT node, coalesce(cycle, node) AS cycle FROM n LEFT JOIN m ON start = node")
def q27(spark, d):
    return G.cycle_groups(fg(spark, d))


@also_whole
@query("q28_links_bottleneck", f"""WITH RECURSIVE {WL}, e AS MATERIALIZED (SELECT src, dst, w FROM wl WHERE w <= 3 UNION ALL SELECT dst, src, w FROM wl WHERE w <= 3), s AS (SELECT DISTINCT src FROM wl WHERE length(src) <= 3),
r(start, node, w) USING KEY (start, node) AS (SELECT src, src, 0 FROM s UNION SELECT r.start, e.dst, min(greatest(r.w, e.w)) FROM r JOIN e ON r.node = e.src LEFT JOIN recurring.r AS o ON o.start = r.start AND o.node = e.dst WHERE o.w IS NULL OR greatest(r.w, e.w) < o.w GROUP BY 1, 2)
SELECT start, node, w FROM r""")
def q28(spark, d, whole=False):
    """From the parts p0 to p99 over all links."""
    edges = wl(spark, d)
    return G.bottleneck_links(G.add_weighted(edges, mirror=True), (edges if whole else edges.where(F.length("src") <= 3)).select("src"), max_weight=3, mirrored=True)


@query("q29_links_merge", f"""WITH {WL}, a AS (SELECT dst AS k, src AS x, w FROM wl), b AS (SELECT 's' || l_suppkey AS k, 'p' || l_partkey AS x, CASE WHEN l_returnflag = 'R' THEN -1 ELSE greatest(l_linenumber - 1, 2) END AS w FROM lineitem),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT k, x, CASE WHEN bool_or(w = 0) THEN 0 ELSE min(w) END AS w FROM u GROUP BY ALL""")
def q29(spark, d):
    a = wl(spark, d).select(F.col("dst").alias("k"), F.col("src").alias("x"), "w")
    b = t(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("k"), F.concat(F.lit("p"), "l_partkey").alias("x"), F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.col("l_linenumber") - 1).alias("w"))
    return merge_links(a, b, ["k", "x"], minimum=2)


@query("q30_clusters", f"""WITH RECURSIVE {WL}, e AS MATERIALIZED (SELECT src AS a, dst AS b FROM wl WHERE w BETWEEN 0 AND 2 UNION SELECT dst, src FROM wl WHERE w BETWEEN 0 AND 2), n AS MATERIALIZED (SELECT src AS node FROM wl UNION SELECT dst FROM wl),
r(node, cluster) USING KEY (node) AS (SELECT node, node FROM n UNION SELECT e.b, min(r.cluster) FROM r JOIN e ON r.node = e.a JOIN recurring.r AS o ON o.node = e.b WHERE r.cluster < o.cluster GROUP BY e.b) SELECT node, cluster FROM r""")
def q30(spark, d):
    return G.clusters(wl(spark, d), 0, 2)


@query("q31_relational_division", "WITH m AS (SELECT DISTINCT p_name AS f, p_brand || p_type AS m FROM part) SELECT a.f, b.f AS g FROM (SELECT DISTINCT f FROM m) a, (SELECT DISTINCT f FROM m) b WHERE a.f <> b.f AND NOT EXISTS (SELECT 1 FROM m x WHERE x.f = a.f AND NOT EXISTS (SELECT 1 FROM m y WHERE y.f = b.f AND y.m = x.m))")
def q31(spark, d):
    from graphloom.operators.entities import contained_sets

    return contained_sets(t(spark, d, "part").select(F.col("p_name").alias("f"), F.concat("p_brand", "p_type").alias("m")), "f", "m")


# rules --------------------------------------------------------------------------------------------------------

@query("q32_fixpoint_final", "SELECT p_partkey AS field, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber > 5 AND l_quantity > 40) THEN 0 ELSE 1 END AS v FROM part")
def q32(spark, d):
    from graphloom.plans.rules import field_final

    fields = t(spark, d, "part").select(F.col("p_partkey").alias("field"), F.lit(False).alias("is_final"), F.lit(False).alias("writable_outside"), F.lit(False).alias("is_static"))
    outside = F.expr("l_returnflag = 'R' and l_linenumber > 5 and l_quantity > 40")
    assigned = t(spark, d, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("method"), outside.alias("outside_construction"))
    return field_final(fields, assigned)


@query("q33_fixpoint_modified", f"WITH RECURSIVE {FG}, r(node) AS (SELECT src FROM fg WHERE src % 13 = 0 UNION SELECT src FROM r JOIN fg ON node = dst) SELECT src AS method, CASE WHEN r.node IS NULL THEN 0 ELSE 1 END AS v FROM fg LEFT JOIN r ON r.node = src")
def q33(spark, d):
    from graphloom.plans.rules import modified_through_calls

    calls = fg(spark, d)
    return modified_through_calls(calls.select(F.col("src").alias("method")), calls, calls.where("src % 13 = 0").select("src"))


@query("q34_group_decision", f"WITH {DV}, m AS (SELECT g, l_orderkey AS grp, CASE WHEN v = -1 THEN -1 WHEN v = 21 THEN 1 ELSE 0 END AS v FROM dv) SELECT g, grp, CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = 0 THEN 0 ELSE -1 END AS v FROM m GROUP BY ALL")
def q34(spark, d):
    m = dv(spark, d).select("g", F.col("l_orderkey").alias("grp"), F.when(F.col("v") == -1, F.col("v")).when(F.col("v") == 21, F.lit(1)).otherwise(F.lit(0)).alias("v"))
    return m.groupBy("g", "grp").agg(L.group_decision(F.col("v")).alias("v"))


# flow ---------------------------------------------------------------------------------------------------------

_KINDS = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 3 END"


@query("q35_reachability", "SELECT conv_id AS block, turn AS pos, coalesce(min(CASE WHEN length(text) > 2000 THEN 0 WHEN length(text) > 900 THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS reached FROM conversations")
def q35(spark, d):
    from graphloom.plans.flow import reachability

    after = F.when(F.col("size") > 2000, F.lit(0)).when(F.col("size") > 900, F.lit(1)).otherwise(F.lit(2))
    return reachability(seq(spark, d).withColumn("after", after), ["block"], "pos").select("block", "pos", "reached")


@query("q36_interrupts", f"SELECT conv_id AS block, {_KINDS} AS interrupt, least(max(CASE WHEN length(text) > 300 THEN 2 ELSE 1 END), 2) AS v FROM conversations GROUP BY ALL")
def q36(spark, d):
    from graphloom.plans.flow import merge_interrupts

    kind = F.when(F.col("kind") == "system", F.lit(0)).when(F.col("kind") == "user", F.lit(1)).otherwise(F.lit(3))
    rows = seq(spark, d).select("block", kind.alias("interrupt"), F.when(F.col("size") > 300, F.lit(2)).otherwise(F.lit(1)).alias("v"), F.lit(2).alias("execution"))
    return merge_interrupts(rows, ["block"])


@query("q37_loop_counts", "SELECT p_partkey, CAST(ceil((p_size - 10) / (p_size % 4 + 1)) AS BIGINT) AS n, CASE WHEN p_size <= 10 THEN 'EMPTY_LOOP' WHEN ceil((p_size - 10) / (p_size % 4 + 1)) = 1 THEN 'LOOP_ONCE' END AS message FROM part")
def q37(spark, d):
    from graphloom.plans.flow import loop_count, loop_message

    part = t(spark, d, "part").select("p_partkey", F.lit(10).alias("start"), F.col("p_size").alias("end_excl"), (F.col("p_size") % 4 + 1).alias("inc"))
    return part.select("p_partkey", F.expr("ceil((end_excl - start) / inc)").cast("long").alias("n"), loop_message(F.col("start"), F.col("end_excl"), F.col("inc")).alias("message")).where(loop_count(F.col("start"), F.col("end_excl"), F.col("inc")).isNotNull())


# diagnostics --------------------------------------------------------------------------------------------------

@query("q38_unused", "SELECT p_partkey AS element FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 30 AND l_linenumber = 1)")
def q38(spark, d):
    from graphloom.plans.diagnostics import unused

    read = t(spark, d, "lineitem").where("l_quantity > 30 and l_linenumber = 1").select(F.col("l_partkey").alias("element"))
    return unused(t(spark, d, "part").select(F.col("p_partkey").alias("element")), read)


@query("q39_useless_assignment", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE event_type = after AND event_type = (SELECT min(event_type) FROM events)")
def q39(spark, d):
    from graphloom.plans.diagnostics import overwritten

    e = t(spark, d, "events")
    write = e.agg(F.min("event_type").alias("write"))
    acts = e.join(F.broadcast(write)).select("user_id", "event_id", "ts", (F.col("event_type") == F.col("write")).alias("assigns"))
    return overwritten(acts, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("q40_expected_vs_actual", "WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 2000), e AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT doc_id AS element, CASE WHEN a.doc_id IS NULL THEN 'ANNOTATION_ABSENT' ELSE 'ANNOTATION_UNEXPECTEDLY_PRESENT' END AS label FROM e FULL JOIN a USING (doc_id) WHERE e.doc_id IS NULL OR a.doc_id IS NULL")
def q40(spark, d):
    from graphloom.plans.diagnostics import expected_against_computed

    computed = t(spark, d, "documents").where("n_chars > 2000").select(F.col("doc_id").alias("element"))
    expected = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("element"))
    return expected_against_computed(expected, computed, ["element"])


@query("q41_prefix_visit", "SELECT split_part(url, '/', 3) AS host, count(DISTINCT url) AS n FROM pages WHERE starts_with(url, 'http') GROUP BY ALL")
def q41(spark, d):
    from graphloom.sources.filters import accepts

    pages = t(spark, d, "pages").where(accepts(F.col("url"), ["http."], dotted=False)).select("url").distinct()
    return pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("q42_usage_collect", "SELECT kind, element FROM (SELECT 'type' AS kind, event_type AS element FROM events UNION SELECT 'user', CAST(user_id AS VARCHAR) FROM events UNION SELECT 'key', unnest(json_keys(props)) FROM events) WHERE element IS NOT NULL")
def q42(spark, d):
    e = t(spark, d, "events")
    refs = F.explode(F.concat(F.array(F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("element")), F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("element"))), F.transform(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")), lambda k: F.struct(F.lit("key").alias("kind"), k.alias("element"))))).alias("r")
    return e.select(refs).select("r.kind", "r.element").where("element is not null").distinct()


FLAGSHIP = q41

from graphloom.plans import diagnostic_queries, entity_queries, expression_queries, property_queries, rule_queries, source_queries, statement_queries  # noqa: E402, F401  (they add their queries)
