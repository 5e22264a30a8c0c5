"""Entity, graph, link, source and sink operators over a program made from the tables, and their SQL.

Customers are types (a type's parent has half its number), orders methods of their customer, parts and suppliers fields.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.operators import entities as E
from graphloom.operators import graph as G
from graphloom.operators import links as K
from graphloom.plans.catalogue import DV, TREE, dv, query, t, tree
from graphloom.sources import facts as S
from graphloom.sources import filters as P
from graphloom.sources import sinks as O
from graphloom.staging import fresh_path

TYPES = """types AS (SELECT c_custkey AS k, 'c' || c_custkey AS type_fqn, 'p' || c_nationkey AS package, CASE WHEN c_custkey > 0 THEN 'c' || (c_custkey // 2) END AS parent, 'i' || (c_nationkey % 5) AS iface,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN 'c' || (c_custkey // 3) END AS enclosing, 'c' || (c_custkey % 7) AS primary_type, CASE WHEN c_custkey % 4 = 0 THEN 'INTERFACE' ELSE 'CLASS' END AS nature FROM customer)"""
METHODS = """methods AS (SELECT o_orderkey AS k, 'm' || o_orderkey AS method_fqn, 'c' || o_custkey AS type_fqn, CASE WHEN o_orderkey % 20 = 0 THEN '$static' || (o_orderkey % 3) ELSE 'f' || (o_orderkey % 5) END AS name, o_orderkey % 11 = 0 AS is_ctor,
  o_orderkey % 7 = 0 OR o_orderkey % 20 = 0 AS is_static, CASE o_orderkey % 3 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' ELSE 'PRIVATE' END AS access, o_orderkey % 97 = 0 AS is_abstract, o_orderkey % 13 = 0 AS is_default, o_orderkey % 2 AS n_params FROM orders)"""
DIRECT = "direct AS (SELECT type_fqn AS t, parent AS s FROM types WHERE parent IS NOT NULL UNION SELECT type_fqn, iface FROM types)"
UP = "up(t, s, n) AS (SELECT t, s, 1 FROM direct UNION SELECT u.t, d.s, n + 1 FROM up u JOIN direct d ON u.s = d.t), supers AS (SELECT t, s, min(n) AS n FROM up GROUP BY ALL)"
AROUND = "around(t, h) AS (SELECT type_fqn, type_fqn FROM types UNION SELECT a.t, x.enclosing FROM around a JOIN types x ON x.type_fqn = a.h WHERE x.enclosing IS NOT NULL)"


def types(spark, d):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    return t(spark, d, "customer").select(
        F.concat(F.lit("c"), k).alias("type_fqn"), F.concat(F.lit("p"), nation).alias("package"), F.expr("CASE WHEN c_custkey > 0 THEN concat('c', c_custkey div 2) END").alias("parent"), F.array(F.concat(F.lit("i"), nation % 5)).alias("interfaces"),
        F.expr("CASE WHEN c_custkey % 3 = 0 AND c_custkey > 0 THEN concat('c', c_custkey div 3) END").alias("enclosing"), F.concat(F.lit("c"), k % 7).alias("primary_type"), F.when(k % 4 == 0, F.lit("INTERFACE")).otherwise(F.lit("CLASS")).alias("nature"),
        F.concat(F.lit("N"), k % 9).alias("simple_name"), F.when(k % 5 == 0, F.lit("PRIVATE")).when(k % 5 == 1, F.lit("PACKAGE")).when(k % 5 == 2, F.lit("PROTECTED")).otherwise(F.lit("PUBLIC")).alias("access"),
    )


def methods(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(
        F.concat(F.lit("m"), k).alias("method_fqn"), F.concat(F.lit("c"), "o_custkey").alias("type_fqn"), F.when(k % 20 == 0, F.concat(F.lit("$static"), k % 3)).otherwise(F.concat(F.lit("f"), k % 5)).alias("name"), (k % 11 == 0).alias("is_ctor"),
        ((k % 7 == 0) | (k % 20 == 0)).alias("is_static"), F.when(k % 3 == 0, F.lit("PUBLIC")).when(k % 3 == 1, F.lit("PROTECTED")).otherwise(F.lit("PRIVATE")).alias("access"), (k % 97 == 0).alias("is_abstract"), (k % 13 == 0).alias("is_default"), (k % 2).alias("n_params"),
        F.when(k % 6 == 0, F.lit("real")).when(k % 6 == 1, F.lit("artificial")).alias("of_field_sam"),
    )


# hierarchy and members ----------------------------------------------------------------------------------------

@query("f01_methods_by_mode", f"""WITH RECURSIVE {TYPES}, {METHODS}, {DIRECT}, {UP}, {AROUND}
SELECT 'own' AS mode, type_fqn AS type, method_fqn FROM methods UNION ALL SELECT 'no_sam', type_fqn, method_fqn FROM methods WHERE k % 6 > 1 UNION ALL SELECT 'no_artificial_sam', type_fqn, method_fqn FROM methods WHERE k % 6 <> 1
UNION ALL SELECT 'sub', h, method_fqn FROM around JOIN methods ON type_fqn = t UNION ALL SELECT 'super', t, method_fqn FROM (SELECT t, s FROM supers UNION SELECT type_fqn, type_fqn FROM types) x JOIN methods ON type_fqn = s""")
def f01(spark, d):
    names = {"own": "THIS_TYPE_ONLY", "no_sam": "THIS_TYPE_ONLY_EXCLUDE_FIELD_SAM", "no_artificial_sam": "THIS_TYPE_ONLY_EXCLUDE_FIELD_ARTIFICIAL_SAM", "sub": "INCLUDE_SUBTYPES", "super": "INCLUDE_SUPERTYPES"}
    parts = [E.methods_of(types(spark, d), methods(spark, d), mode).select(F.lit(n).alias("mode"), "type", "method_fqn") for n, mode in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f02_constructors_and_methods", f"WITH {METHODS} SELECT type_fqn AS type, count(*) FILTER (is_ctor) AS ctors, count(*) FILTER (NOT is_ctor) AS others FROM methods GROUP BY 1")
def f02(spark, d):
    m = methods(spark, d)
    return E.methods_of(types(spark, d), m).join(m.select("method_fqn", "is_ctor"), "method_fqn").groupBy("type").agg(F.count_if("is_ctor").alias("ctors"), F.count_if(~F.col("is_ctor")).alias("others"))


@query("f03_methods_in_initialisers", f"WITH {METHODS} SELECT 's' || s_suppkey AS field_fqn, method_fqn FROM supplier JOIN methods ON type_fqn = 'c' || s_suppkey WHERE s_suppkey % 2 = 0")
def f03(spark, d):
    f = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("field_fqn"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("c"), "s_suppkey")).alias("initialiser"))
    return E.methods_in_initialisers(f, methods(spark, d))


@query("f04_static_blocks", f"WITH RECURSIVE {TYPES}, {METHODS}, {AROUND} SELECT h AS type, method_fqn FROM around JOIN methods ON type_fqn = t WHERE is_static AND starts_with(name, '$static')")
def f04(spark, d):
    return E.static_blocks(types(spark, d), methods(spark, d))


_REACH = f"WITH RECURSIVE {TYPES}, {DIRECT}, {UP}, {AROUND}, reach AS (SELECT t, h, bool_or(b) AS below FROM (SELECT t, s AS h, true AS b FROM supers UNION ALL SELECT t, h, false FROM around) r GROUP BY ALL), seen AS (SELECT r.t, r.h, below, a.package = b.package AS near, a.primary_type = b.primary_type AS prim FROM reach r JOIN types a ON a.type_fqn = r.t JOIN types b ON b.type_fqn = r.h)"
_ACCESS = "prim OR access = 'PUBLIC' OR (access = 'PROTECTED' AND (near OR below)) OR (access = 'PACKAGE' AND near)"
_BY_SIZE = "CASE p_size % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PROTECTED' WHEN 2 THEN 'PACKAGE' ELSE 'PRIVATE' END"


@query("f06_accessible_fields", f"{_REACH}, f AS (SELECT 'c' || (p_partkey % 500) AS h, 'x' || p_partkey AS field_fqn, {_BY_SIZE} AS access FROM part) SELECT DISTINCT t AS type, field_fqn FROM seen JOIN f USING (h) WHERE {_ACCESS}")
def f06(spark, d):
    f = t(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey") % 500).alias("type_fqn"), F.concat(F.lit("x"), "p_partkey").alias("field_fqn"), F.expr(_BY_SIZE).alias("access"))
    return E.accessible_fields(types(spark, d), f)


@query("f07_accessible_types", f"{_REACH}, f AS (SELECT enclosing AS h, 'N' || (k % 9) AS simple_name, type_fqn, CASE k % 5 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PACKAGE' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC' END AS access FROM types WHERE enclosing IS NOT NULL) SELECT DISTINCT t AS type, simple_name, f.type_fqn FROM seen JOIN f USING (h) WHERE {_ACCESS}")
def f07(spark, d):
    return E.accessible_types(types(spark, d))


@query("f08_direct_supers", f"WITH {TYPES}, {DIRECT} SELECT t AS src, s AS dst FROM direct")
def f08(spark, d):
    return E.direct_supers(types(spark, d))


@query("f09_supers", f"WITH RECURSIVE {TYPES}, {DIRECT.replace('IS NOT NULL', 'IS NOT NULL AND parent <> ' + chr(39) + 'c0' + chr(39))}, {UP} SELECT t AS type, s AS super, n AS distance FROM supers")
def f09(spark, d):
    return E.supers(types(spark, d), root="c0")


@query("f10_overrides", f"""WITH RECURSIVE {TYPES}, {METHODS}, {DIRECT}, {UP}, sig AS (SELECT method_fqn, type_fqn, name, CASE WHEN k % 4 <> 0 THEN 't' || (k % 2) ELSE '' END AS args FROM methods WHERE NOT is_ctor AND NOT is_static AND access <> 'PRIVATE')
SELECT a.method_fqn, b.method_fqn AS overridden, n AS distance FROM sig a JOIN supers ON t = a.type_fqn JOIN sig b ON b.type_fqn = s AND b.name = a.name AND b.args = a.args""")
def f10(spark, d):
    k = F.col("o_orderkey")
    p = t(spark, d, "orders").where(k % 4 != 0).select(F.concat(F.lit("m"), k).alias("method_fqn"), F.lit(0).alias("index"), F.concat(F.lit("t"), k % 2).alias("ptype"))
    return E.overrides(types(spark, d), methods(spark, d), p)


@query("f11_functional_interfaces", f"""WITH RECURSIVE {TYPES}, {METHODS}, {DIRECT}, {UP}, r AS (SELECT t, s FROM supers UNION SELECT type_fqn, type_fqn FROM types), one AS (SELECT t FROM r JOIN methods ON type_fqn = s WHERE is_abstract AND NOT is_static AND NOT is_default GROUP BY t HAVING count(DISTINCT (name, n_params)) = 1)
SELECT t AS type FROM one JOIN types ON type_fqn = t WHERE nature = 'INTERFACE'""")
def f11(spark, d):
    return E.functional_interfaces(types(spark, d), methods(spark, d))


_WIDTHS = "w(p, n) AS (VALUES ('byte', 0), ('short', 1), ('char', 1), ('int', 2), ('long', 3), ('float', 4), ('double', 5))"
_NAMES = ("int", "long", "byte", "double", "java.lang.Integer", "char", "java.lang.Object")
_PAIRS = f"names AS (SELECT unnest({list(_NAMES)!r}) AS nm, generate_subscripts({list(_NAMES)!r}, 1) - 1 AS i), pairs AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'c' || (l_suppkey % 50) ELSE a.nm END AS target, CASE WHEN l_linenumber = 1 THEN 'c' || (l_partkey % 200) ELSE b.nm END AS source FROM lineitem JOIN names a ON a.i = l_suppkey % 7 JOIN names b ON b.i = l_partkey % 7)"


@query("f13_assignable", f"""WITH RECURSIVE {TYPES}, {DIRECT}, {UP}, {_WIDTHS}, {_PAIRS} SELECT target, source, coalesce(CASE WHEN target = source THEN 0 WHEN a.n > b.n AND target <> 'char' THEN a.n - b.n WHEN (target, source) IN (('int', 'java.lang.Integer'), ('java.lang.Integer', 'int')) THEN 1
  WHEN supers.n IS NOT NULL THEN supers.n WHEN target = 'java.lang.Object' AND source NOT IN ('int', 'long', 'byte', 'double', 'char') THEN 100 END, -1) AS distance FROM pairs LEFT JOIN w a ON a.p = target LEFT JOIN w b ON b.p = source LEFT JOIN supers ON t = source AND s = target""")
def f13(spark, d):
    li, first = t(spark, d, "lineitem"), F.col("l_linenumber") == 1
    name = lambda c, mod: F.when(first, F.concat(F.lit("c"), F.col(c) % mod)).otherwise(F.get(F.array(*map(F.lit, _NAMES)), (F.col(c) % 7).cast("int")))
    pairs = li.select(name("l_suppkey", 50).alias("target"), name("l_partkey", 200).alias("source")).distinct()
    return E.assignable(pairs, E.supers(types(spark, d))).select("target", "source", F.coalesce("distance", F.lit(-1)).alias("distance"))


@query("s16_best_overload", """WITH c AS (SELECT o_orderkey AS call_id, v.m AS method_fqn, v.formal, CASE o_orderkey % 3 WHEN 0 THEN 'byte' WHEN 1 THEN 'int' ELSE 'long' END AS actual FROM orders, (VALUES ('a', 'int'), ('b', 'long'), ('c', 'double'), ('d', 'long')) v(m, formal)),
w(p, n) AS (VALUES ('byte', 0), ('int', 2), ('long', 3), ('double', 5)), r AS (SELECT call_id, method_fqn, a.n - b.n AS d FROM c JOIN w a ON a.p = formal JOIN w b ON b.p = actual WHERE a.n >= b.n) SELECT call_id, method_fqn FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY d, method_fqn) AS i FROM r) WHERE i = 1""")
def s16(spark, d):
    k = F.col("o_orderkey")
    formals = F.explode(F.array(*(F.struct(F.lit(m).alias("method_fqn"), F.lit(f).alias("formal")) for m, f in (("a", "int"), ("b", "long"), ("c", "double"), ("d", "long"))))).alias("f")
    actual = F.when(k % 3 == 0, F.lit("byte")).when(k % 3 == 1, F.lit("int")).otherwise(F.lit("long"))
    rows = t(spark, d, "orders").select(k.alias("call_id"), actual.alias("actual"), formals).select("call_id", "f.method_fqn", F.lit(0).alias("index"), "f.formal", "actual")
    return E.best_overload(rows, E.supers(types(spark, d)))


@query("f14_not_read_after_assignment", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < o_custkey % 10 OR 5 < o_custkey % 10 THEN coalesce(CAST(o_orderkey % 7 AS VARCHAR), '') < CASE WHEN 5 < o_custkey % 10 AND o_orderkey % 10 < o_custkey % 10 THEN greatest(CAST(o_orderkey % 10 AS VARCHAR), '5') WHEN 5 < o_custkey % 10 THEN '5' ELSE CAST(o_orderkey % 10 AS VARCHAR) END ELSE false END AS v FROM orders")
def f14(spark, d):
    text = lambda c, n: (F.col(c) % n).cast("string")
    return t(spark, d, "orders").select("o_orderkey", E.not_read_after_assignment(text("o_orderkey", 7), F.array(text("o_orderkey", 10), F.lit("5")), text("o_custkey", 10)).alias("v"))


@query("f15_own_clauses", "WITH c AS (SELECT o_custkey AS expr_id, 'k' || (o_orderkey % 20) AS clause, o_orderkey % 3 AS x, o_orderkey % 4 AS y FROM orders) SELECT expr_id, string_agg(DISTINCT clause, ';' ORDER BY clause) AS clauses, mine FROM (SELECT expr_id, clause, expr_id % 2 = 0 AND x < 2 AND y < 2 AS mine FROM c) GROUP BY expr_id, mine")
def f15(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    clauses = o.select(F.col("o_custkey").alias("expr_id"), F.concat(F.lit("k"), k % 20).alias("clause"), F.array(F.concat(F.lit("v"), k % 3), F.concat(F.lit("v"), k % 4)).alias("vars"))
    wanted = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("expr_id"), F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("var")).distinct()
    both = [E.own_clauses(clauses, wanted, accept).select("expr_id", F.array_join("clauses", ";").alias("clauses"), F.lit(accept).alias("mine")) for accept in (True, False)]
    return both[0].unionByName(both[1])


@query("f16_subtree", "WITH RECURSIVE c AS (SELECT c_custkey AS k, c_mktsegment = 'BUILDING' AS stop FROM customer), d(root, node) AS (SELECT k, k FROM c WHERE k % 10 = 1 UNION SELECT d.root, x.k FROM d JOIN c ON c.k = d.node AND NOT c.stop JOIN c x ON x.k // 2 = d.node AND x.k > 0 AND x.k <> d.node) SELECT root, node AS expr_id FROM d")
def f16(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("expr_id"), F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 2 END").alias("parent_id"), "c_mktsegment")
    return E.subtree(c, c.where("expr_id % 10 = 1").select("expr_id"), F.col("c_mktsegment") == "BUILDING")


@query("g21_usage", "SELECT DISTINCT kind, target AS target_fqn FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'field' ELSE 'type' END AS kind, 'e' || (o_orderkey % 40) AS target, 'a.b' || (o_custkey % 4) AS p FROM orders) WHERE kind <> 'type' AND p IN ('a.b1', 'a.b3') UNION SELECT DISTINCT 'type', 't' || (o_orderkey % 9) FROM orders WHERE o_custkey % 4 IN (1, 3)")
def g21(spark, d):
    k = F.col("o_orderkey")
    refs = t(spark, d, "orders").select(F.when(k % 3 == 0, F.lit("method")).when(k % 3 == 1, F.lit("field")).otherwise(F.lit("type")).alias("kind"), F.concat(F.lit("e"), k % 40).alias("target_fqn"), F.concat(F.lit("t"), k % 9).alias("target_type"), F.concat(F.lit("a.b"), F.col("o_custkey") % 4).alias("target_package"))
    return E.usage(refs, ["a.b1", "a.b3."])


@query("g22_type_sets", "WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ['*'] ELSE list_distinct(['t' || (p_size % 3), 't' || (p_size % 4)]) END AS a, list_distinct(['t' || (p_size % 2), 't3']) AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(CASE WHEN p_size5 THEN list_sort(b) ELSE list_sort(list_intersect(a, b)) END, ',') AS both_ FROM (SELECT *, list_contains(a, '*') AS p_size5 FROM s)")
def g22(spark, d):
    n = F.col("p_size")
    name = lambda m: F.concat(F.lit("t"), n % m)
    rows = t(spark, d, "part").select("p_partkey", F.when(n % 5 == 0, F.array(F.lit("*"))).otherwise(F.array_distinct(F.array(name(3), name(4)))).alias("a"), F.array_sort(F.array_distinct(F.array(name(2), F.lit("t3")))).alias("b"))
    return rows.select("p_partkey", F.array_join(E.union_types(F.col("a"), F.col("b")), ",").alias("either"), F.array_join(E.common_types(F.col("a"), F.col("b")), ",").alias("both_"))


@query("j07_companions", "SELECT 'm' || p_partkey AS method_fqn, 't' || p_size AS type_fqn, 'add' || (p_partkey % 3) AS base, CASE p_size % 3 WHEN 0 THEN 'Modification' ELSE 'Value' END AS action, CASE WHEN p_size % 3 = 1 THEN 'Size' END AS aspect FROM part WHERE p_size % 3 < 2 OR p_partkey % 2 = 0")
def j07(spark, d):
    name = F.expr("concat('add', p_partkey % 3, CASE p_size % 3 WHEN 0 THEN '$Modification' WHEN 1 THEN '$Value$Size' ELSE CASE WHEN p_partkey % 2 = 0 THEN '$Value' ELSE '$value' END END)")
    return E.companions(t(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey").alias("method_fqn"), F.concat(F.lit("t"), "p_size").alias("type_fqn"), name.alias("name")))


@query("o07_o09_analysis_order", "WITH n AS (SELECT 'c' || c_custkey AS node, c_custkey % 13 AS layer FROM customer) SELECT node, row_number() OVER (ORDER BY layer, node) - 1 AS by_layer, row_number() OVER (ORDER BY node) - 1 AS by_name FROM n")
def o07(spark, d):
    rows = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_custkey") % 13).alias("layer"))
    return E.positions(rows, ["layer", "node"]).withColumnRenamed("position", "by_layer").join(E.positions(rows.select("node"), ["node"]).withColumnRenamed("position", "by_name"), "node").select("node", "by_layer", "by_name")


# graphs and links ---------------------------------------------------------------------------------------------

@query("g04_induced_reverse", f"WITH {TREE} SELECT dst AS src, src AS dst FROM tree WHERE src % 3 <> 1 AND dst % 3 <> 1")
def g04(spark, d):
    return G.induced(tree(spark, d), t(spark, d, "customer").where("c_custkey % 3 <> 1").select("c_custkey"), reverse=True)


@query("g05_add_node", f"WITH {TREE}, m AS (SELECT o_custkey AS src, o_custkey // 2 AS dst FROM orders) SELECT * FROM tree UNION SELECT * FROM m UNION SELECT dst, src FROM m")
def g05(spark, d):
    return G.add_node(tree(spark, d), t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 2").alias("dst")), bidirectional=True)


@query("g06_size_and_relations", f"WITH {TREE} SELECT (SELECT count(*) FROM (SELECT src FROM tree UNION SELECT dst FROM tree)) AS n_nodes, (SELECT count(*) FROM tree) AS n_relations")
def g06(spark, d):
    return G.size_and_relations(tree(spark, d))


@query("g11_spread_over_clusters", f"WITH {DV}, c AS (SELECT DISTINCT g AS node, g % 7 AS cluster FROM dv), m AS (SELECT g AS node, max(CASE WHEN l_orderkey % 997 = 0 THEN -1 ELSE v END) AS hi, min(CASE WHEN l_orderkey % 997 = 0 THEN -1 ELSE abs(v) END) AS lo FROM dv GROUP BY 1), e AS (SELECT cluster, min(lo) AS lo, max(hi) AS hi FROM c JOIN m USING (node) GROUP BY 1) SELECT node, CASE WHEN lo = -1 THEN -1 ELSE hi END AS v, hi AS broken FROM c JOIN e USING (cluster)")
def g11(spark, d):
    v = F.when(F.col("l_orderkey") % 997 == 0, F.lit(-1)).otherwise(F.abs("v"))
    rows = dv(spark, d).select(F.col("g").alias("node"), v.alias("v"))
    each = rows.groupBy("node").agg(L.most(F.col("v")).alias("v"))
    best = rows.groupBy("node").agg(L.most_ignoring_delay(F.col("v")).alias("v"))
    cluster = rows.select("node", (F.col("node") % 7).alias("cluster")).distinct()
    plain, broken = G.spread_over_clusters(each, cluster), G.spread_over_clusters(best, cluster, break_delay=True).withColumnRenamed("v", "broken")
    return plain.join(broken, "node")


@query("g12_one_way", f"WITH RECURSIVE {TREE}, e AS (SELECT src AS a, dst AS b FROM tree WHERE src % 5 <> 0 AND src <> 3 AND dst <> 3), b AS (SELECT * FROM e UNION SELECT b, a FROM e), n AS (SELECT src AS node FROM tree UNION SELECT dst FROM tree), r(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, b.b FROM r JOIN b ON other = b.a) SELECT node, min(other) AS cluster FROM r GROUP BY 1")
def g12(spark, d):
    return G.clusters(tree(spark, d).withColumn("w", F.when(F.col("src") % 5 == 0, F.lit(100)).otherwise(F.lit(0))), 0, 0, one_way=3)


@query("g16_link_maps", "WITH l AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(CASE WHEN l_linenumber = 7 THEN -1 ELSE l_linenumber - 1 END) AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, CASE WHEN w = -1 THEN -1 ELSE greatest(w, 2) END AS least2, CASE WHEN w = 0 THEN 0 ELSE -1 END AS delayed, w <> -1 AS kept, 3 AS fixed FROM l WHERE dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size % 5 = 0)")
def g16(spark, d):
    n = F.col("l_linenumber")
    links = t(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.min(F.when(n == 7, F.lit(-1)).otherwise(n - 1)).alias("w"))
    links = K.without(links, t(spark, d, "part").where("p_size % 5 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    w = F.col("w")
    mapped = links.select("src", "dst", K.at_least(w, 2).alias("least2"), K.to_delay(w).alias("delayed"))
    kept = K.non_delayed_part(links).select("src", "dst", F.lit(True).alias("kept"))
    fixed = K.change_all_to(links, 3).select("src", "dst", F.col("w").alias("fixed"))
    return mapped.join(kept, ["src", "dst"], "left").join(fixed, ["src", "dst"]).select("src", "dst", "least2", "delayed", F.coalesce("kept", F.lit(False)).alias("kept"), "fixed")


@query("g18_link_levels", "WITH v AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 13 WHEN 4 THEN 21 ELSE 805 END AS v, CASE p_size % 7 WHEN 0 THEN -1 WHEN 6 THEN 100 ELSE p_size % 7 - 1 END AS w FROM part) SELECT p_partkey, CASE v WHEN -1 THEN -1 WHEN 805 THEN 100 WHEN 1 THEN 2 ELSE (v >> 3) + 3 END AS link, CASE WHEN w = -1 THEN -1 WHEN w = 100 THEN 805 WHEN w <= 2 THEN 1 ELSE (w - 3) * 8 + 5 END AS independent FROM v")
def g18(spark, d):
    n = F.col("p_size")
    v = F.get(F.array(*map(F.lit, (-1, 1, 5, 13, 21, 805))), (n % 6).cast("int"))
    w = F.when(n % 7 == 0, F.lit(-1)).when(n % 7 == 6, F.lit(100)).otherwise(n % 7 - 1)
    return t(spark, d, "part").select("p_partkey", K.link_of_independence(v).alias("link"), K.independence_of_link(w).alias("independent"))


@query("l11_causes_cap", f"WITH {DV}, c AS (SELECT g, l_orderkey % 7 AS cause, l_linenumber AS place, l_orderkey AS stmt, v >= 16 AS high FROM dv), m AS (SELECT g, max(high) AS high FROM c GROUP BY g), o AS (SELECT g, cause, place, min(stmt) AS stmt FROM c JOIN m USING (g, high) GROUP BY ALL) SELECT g, cause, place, stmt FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY stmt, cause, place) AS n FROM o) WHERE n <= 5")
def l11(spark, d):
    causes = dv(spark, d).select("g", (F.col("l_orderkey") % 7).alias("cause"), F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("stmt"), (F.col("v") >= 16).alias("high"))
    return L.merge_causes(causes, ["g"], cap=5)


# sources ------------------------------------------------------------------------------------------------------

@query("s04_imports", f"WITH {TYPES}, i AS (SELECT o_orderkey AS src_type, o_custkey AS k, o_orderkey % 4 AS kind FROM orders) SELECT DISTINCT src_type, type_fqn FROM i JOIN types ON (kind < 2 AND type_fqn = 'c' || i.k) OR (kind = 2 AND types.enclosing IS NULL AND package = 'p' || (i.k % 25)) OR (kind = 3 AND types.enclosing = 'c' || (i.k % 50))")
def s04(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("c"), c)).when(k % 4 == 1, F.concat(F.lit("c"), c, F.lit(".member"))).when(k % 4 == 2, F.concat(F.lit("p"), c % 25)).otherwise(F.concat(F.lit("c"), c % 50))
    imports = t(spark, d, "orders").select(k.alias("src_type"), name.alias("name"), (k % 4 >= 2).alias("is_star"), (k % 4 == 1).alias("is_static"))
    return S.resolve_imports(imports, types(spark, d))


@query("s09_s10_annotation_xml", "SELECT 'parameter' AS target_kind, 'a.p' || p_size || '.T f' || p_partkey || '(int)' AS target_fqn, CAST(p_partkey % 3 AS INTEGER) AS place, 'x.NotNull' AS annotation FROM part WHERE p_partkey % 4 = 0 AND p_size % 2 = 1 UNION ALL SELECT 'method', 'a.p' || p_size || '.T f' || p_partkey || '(int)', -1, 'x.Modified' FROM part WHERE p_partkey % 4 = 1 AND p_size % 2 = 1 UNION ALL SELECT 'field', 'a.p' || p_size || '.T f' || p_partkey, -1, 'x.Final' FROM part WHERE p_partkey % 4 = 2 AND p_size % 2 = 1 UNION ALL SELECT 'type', 'a.p' || p_size || '.T' || p_partkey, -1, 'x.Container' FROM part WHERE p_partkey % 4 = 3 AND p_size % 2 = 1")
def s09(spark, d):
    """K1 and S9 by round trip: items written as XML, a folder for each package, and read again; then S10's package filter."""
    name = F.expr("concat('a.p', p_size, '.T', CASE p_partkey % 4 WHEN 0 THEN concat(' f', p_partkey, '(int) ', p_partkey % 3) WHEN 1 THEN concat(' f', p_partkey, '(int)') WHEN 2 THEN concat(' f', p_partkey) ELSE CAST(p_partkey AS STRING) END)")
    said = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'x.NotNull' WHEN 1 THEN 'x.Modified' WHEN 2 THEN 'x.Final' ELSE 'x.Container' END")
    items = t(spark, d, "part").select(F.expr("concat('a.p', p_size)").alias("package"), name.alias("name"), F.array(F.struct(said.alias("_name"))).alias("annotations"))
    path = fresh_path(spark, "xml")
    O.write_annotation_xml(items, path)
    found = S.read_annotation_xml(spark, path)
    package = F.regexp_extract("target_fqn", r"^(a\.p\d+)\.T", 1)
    odd = [f"a.p{n}" for n in range(1, 100, 2)]
    return found.where(P.package_pattern(package, odd)).select("target_kind", "target_fqn", F.coalesce("index", F.lit(-1)).alias("place"), "annotation")


@query("k01_xml_prefixes", "SELECT 'a.p' || p_size || '.T' || p_partkey AS target_fqn FROM part WHERE p_size = 7 OR p_size = 11")
def k01(spark, d):
    items = t(spark, d, "part").select(F.expr("concat('a.p', p_size)").alias("package"), F.expr("concat('a.p', p_size, '.T', p_partkey)").alias("name"), F.array(F.struct(F.lit("x.Final").alias("_name"))).alias("annotations"))
    path = fresh_path(spark, "xml")
    O.write_annotation_xml(items, path, ["a.p7", "a.p11"])
    return S.read_annotation_xml(spark, path).select("target_fqn")


@query("s11_translate_nullness", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'NotNull' WHEN 1 THEN 'Nullable' ELSE 'x.Other' END AS annotation FROM part")
def s11(spark, d):
    n = F.col("p_size") % 3
    return S.translate_nullness(t(spark, d, "part").select("p_partkey", F.when(n == 0, F.lit("org.jetbrains.annotations.NotNull")).when(n == 1, F.lit("org.jetbrains.annotations.Nullable")).otherwise(F.lit("x.Other")).alias("annotation")))


@query("s02_s13_preload", "SELECT 'a.b' || (c_nationkey % 7) || CASE WHEN c_custkey % 2 = 0 THEN '.c' ELSE '' END AS package, c_custkey AS k FROM customer WHERE c_nationkey % 7 IN (1, 3)")
def s13(spark, d):
    rows = t(spark, d, "customer").select(F.expr("concat('a.b', c_nationkey % 7, CASE WHEN c_custkey % 2 = 0 THEN '.c' ELSE '' END)").alias("package"), F.col("c_custkey").alias("k"))
    return P.preload(rows, ["a.b1", "a.b3"])


@query("s02_restricted", f"WITH {TYPES} SELECT type_fqn FROM types WHERE package IN ('p3', 'p4') OR starts_with(package, 'p5.') OR package = 'p5' OR type_fqn = 'c17'")
def s02(spark, d):
    return P.restricted(types(spark, d), ["p3", "p4", "p5.", "c17"]).select("type_fqn")


@query("s15_synthetics", """WITH y AS (SELECT 'c' || c_custkey AS fqn, c_custkey % 3 AS n, 'N' || c_custkey AS simple FROM customer), f AS (SELECT 'c' || (p_partkey % 100) AS fqn, 'x' || p_partkey AS name, 't' || p_size AS ptype, p_size % 4 = 0 AS st FROM part)
SELECT fqn || '.' || v.m || '(' || v.a || ')' AS method_fqn, fqn AS type_fqn, v.m AS name, false AS is_ctor, v.s AS is_static, v.p AS n_params FROM y, (VALUES ('name', '', false, 0), ('values', '', true, 0), ('valueOf', 'java.lang.String', true, 1)) v(m, a, s, p) WHERE n = 0
UNION ALL SELECT f.fqn || '.' || name || '()', f.fqn, name, false, false, 0 FROM f JOIN y ON y.fqn = f.fqn AND n = 1 WHERE NOT st
UNION ALL SELECT y.fqn || '.' || simple || '(' || coalesce(string_agg(ptype, ',' ORDER BY name, ptype), '') || ')', y.fqn, simple, true, false, CAST(count(name) AS INTEGER) FROM y LEFT JOIN f ON f.fqn = y.fqn AND NOT st WHERE n = 1 GROUP BY y.fqn, simple""")
def s15(spark, d):
    k = F.col("c_custkey")
    y = t(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("type_fqn"), F.concat(F.lit("N"), k).alias("simple_name"), F.when(k % 3 == 0, F.lit("ENUM")).when(k % 3 == 1, F.lit("RECORD")).otherwise(F.lit("CLASS")).alias("nature"))
    f = t(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey") % 100).alias("type_fqn"), F.concat(F.lit("x"), "p_partkey").alias("name"), F.concat(F.lit("t"), "p_size").alias("ptype"), (F.col("p_size") % 4 == 0).alias("is_static"))
    return S.synthetic_members(y, f)


@query("s01_bundle", f"WITH {TYPES} SELECT 'types' AS name, count(*) AS n FROM types UNION ALL SELECT 'calls', count(*) FROM orders UNION ALL SELECT 'links', 0")
def s01(spark, d):
    """Fact tables written as a bundle and read back; a table that isn't there is empty."""
    path = fresh_path(spark, "bundle")
    S.write_bundle({"types": types(spark, d).select("type_fqn", "package"), "calls": t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst"))}, path)
    tables = S.read_bundle(spark, path, ["types", "calls", "links"])
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# sinks --------------------------------------------------------------------------------------------------------

@query("k02_csv_errors", "WITH a AS (SELECT 'm' || o_orderkey AS fqn, ['fluent-m', 'modified-m'][1 + o_orderkey % 2] AS a FROM orders WHERE o_orderkey % 3 <> 0) SELECT fqn, CASE WHEN a IS NULL THEN e WHEN e IS NULL THEN a ELSE a || ',' || e END AS annotations FROM a FULL JOIN (SELECT 'm' || o_orderkey AS fqn, 'error-m' AS e FROM orders WHERE o_orderkey % 4 = 0) x USING (fqn)")
def k02(spark, d):
    k = F.col("o_orderkey")
    m = t(spark, d, "orders").select(F.concat(F.lit("m"), k).alias("fqn"), F.lit("method").alias("kind"), F.when(k % 2 == 0, F.lit("Fluent")).otherwise(F.lit("Modified")).alias("annotation"), k.alias("k"))
    return O.annotation_csv(m.where("k % 3 <> 0"), m.where("k % 4 = 0"))


@query("k03_json", """SELECT '{"m' || o_orderkey || '":"fluent-m"}' AS value FROM orders""")
def k03(spark, d):
    m = t(spark, d, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("fqn"), F.lit("method").alias("kind"), F.lit("Fluent").alias("annotation"))
    return O.annotation_json(O.annotation_csv(m))


@query("k04_stubs", "WITH m AS (SELECT 'p' || c_nationkey AS package, 'T' || (c_custkey % 3) AS type, '    ' || CASE WHEN c_custkey % 2 = 0 THEN '@NotNull @Final ' ELSE '' END || 'int f' || c_custkey || '();' AS line FROM customer), ty AS (SELECT package, type, 'class ' || type || '$ {' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}' || chr(10) AS body FROM m GROUP BY 1, 2) SELECT package, 'package ' || package || ';' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY type) AS stub FROM ty GROUP BY 1")
def k04(spark, d):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    rows = t(spark, d, "customer").select(F.concat(F.lit("p"), "c_nationkey").alias("package"), F.concat(F.lit("T"), k % 3).alias("type"), F.concat(F.lit("int f"), k, F.lit("()")).alias("signature"), F.when(k % 2 == 0, F.array(F.lit("NotNull"), F.lit("Final"))).otherwise(none).alias("annotations"))
    return O.compose_stubs(rows)


@query("k05_message_lines", "SELECT 'WARN in m' || o_orderkey || ': LOOP_ONCE' || CASE WHEN o_orderkey % 2 = 0 THEN ' x' ELSE '' END AS value FROM orders")
def k05(spark, d):
    k = F.col("o_orderkey")
    return O.message_lines(t(spark, d, "orders").select(F.lit("WARN").alias("severity"), F.concat(F.lit("m"), k).alias("loc_id"), F.lit("LOOP_ONCE").alias("label"), F.when(k % 2 == 0, F.lit("x")).alias("extra")))


@query("k08_delay_causes", f"WITH {DV}, c AS (SELECT g AS element, 'c' || (l_orderkey % 7) AS cause, count(*) AS c FROM dv WHERE v = -1 GROUP BY ALL), s AS (SELECT element, sum(c)::BIGINT AS n, string_agg(cause || '=' || c, ',' ORDER BY cause) AS causes FROM c GROUP BY 1) SELECT * FROM s ORDER BY n DESC, element LIMIT 20")
def k08(spark, d):
    rows = dv(spark, d).where("v = -1").select(F.col("g").alias("element"), F.concat(F.lit("c"), F.col("l_orderkey") % 7).alias("cause"))
    return O.delay_histogram(rows).select("element", "n", F.array_join(F.transform("causes", lambda c: F.concat(c["cause"], F.lit("="), c["c"])), ",").alias("causes"))
