"""Rules, flow, entity and diagnostic operators over inputs shaped like program facts, and their SQL.

Types are nations, fields suppliers, methods orders, parameters parts; a line item is a method's access to a field.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.operators import entities as E
from graphloom.operators import graph as G
from graphloom.operators import links as K
from graphloom.plans import diagnostics as D
from graphloom.plans import flow as W
from graphloom.plans import rules as R
from graphloom.plans.catalogue import DV, FG, dv, fg, query, t

ACC = """acc AS (SELECT l_suppkey AS field, l_orderkey AS method, l_partkey AS parameter, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 41 = 0 THEN -1 WHEN l_quantity > 49 AND l_linenumber > 5 THEN 1 ELSE 0 END AS v FROM lineitem)"""
FIELDS = "fields AS (SELECT s_suppkey AS field, s_nationkey AS type, s_acctbal > 8000 AS open_, s_suppkey % 7 = 0 AS prim FROM supplier)"


def acc(spark, d):
    li = t(spark, d, "lineitem")
    v = F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 41 == 0), F.lit(-1)).when((F.col("l_quantity") > 49) & (F.col("l_linenumber") > 5), F.lit(1)).otherwise(F.lit(0))
    return li.select(F.col("l_suppkey").alias("field"), F.col("l_orderkey").alias("method"), F.col("l_partkey").alias("parameter"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), v.alias("v"))


def fields(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("field"), F.col("s_nationkey").alias("type"), (F.col("s_acctbal") > 8000).alias("open_"), (F.col("s_suppkey") % 7 == 0).alias("prim"))


def types(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("type"))


# fields -------------------------------------------------------------------------------------------------------

@query("r01_modified_outside", f"WITH {ACC}, {FIELDS}, s AS (SELECT field, max(v) AS hi, min(v) AS lo FROM (SELECT field, CASE WHEN n > 5 THEN v ELSE 0 END AS v FROM acc) GROUP BY 1) SELECT field, CASE WHEN prim THEN 0 WHEN open_ OR coalesce(hi, 0) = 1 THEN 1 WHEN coalesce(lo, 0) >= 0 THEN 0 ELSE -1 END AS v FROM fields LEFT JOIN s USING (field)")
def r01(spark, d):
    f = fields(spark, d).select("field", F.col("prim").alias("is_primitive"), F.col("open_").alias("writable_outside"))
    return R.modified_outside(f, acc(spark, d).select("field", F.when(F.col("n") > 5, F.col("v")).otherwise(F.lit(0)).alias("v")))


@query("r02_external_not_null", f"WITH {ACC}, {FIELDS}, w AS (SELECT field, min(CASE WHEN n > 4 THEN q % 3 * 4 + 1 ELSE 9 END) AS worst, bool_or(q = 50 AND n = 7) AS nul FROM acc GROUP BY 1), b AS (SELECT field, CASE WHEN min(v) = -1 THEN -1 ELSE max(v) END AS best FROM (SELECT field, CASE WHEN n > 6 THEN v ELSE 1 END AS v FROM acc) GROUP BY 1) SELECT field, CASE WHEN prim THEN 5 WHEN field % 5 = 0 AND open_ THEN 1 WHEN coalesce(nul, false) THEN 1 WHEN coalesce(worst, 1) = -1 OR coalesce(best, 1) = -1 THEN -1 ELSE greatest(coalesce(worst, 1), coalesce(best, 1)) END AS v FROM fields LEFT JOIN w USING (field) LEFT JOIN b USING (field)")
def r02(spark, d):
    f = fields(spark, d).select("field", F.when(F.col("field") % 5 == 0, F.lit(0)).otherwise(F.lit(1)).alias("final"), F.col("open_").alias("writable_outside"), F.col("prim").alias("is_primitive"))
    a = acc(spark, d)
    worst = F.when(F.col("n") > 4, F.col("q") % 3 * 4 + 1).otherwise(F.lit(9))
    return R.external_not_null(f, a.select("field", worst.alias("v"), ((F.col("q") == 50) & (F.col("n") == 7)).alias("is_null")), a.select("field", F.when(F.col("n") > 6, F.col("v")).otherwise(F.lit(1)).alias("v")))


@query("r03_external_immutable", f"WITH {ACC}, {FIELDS}, s AS (SELECT field, min(q % 3 * 8 + 5) AS least FROM acc WHERE n = 7 AND q % 10 <> 0 GROUP BY 1) SELECT field, CASE WHEN field % 5 = 0 AND open_ THEN 1 WHEN field % 11 = 0 THEN 805 WHEN field % 13 = 0 THEN 13 ELSE coalesce(least, 1) END AS v FROM fields LEFT JOIN s USING (field)")
def r03(spark, d):
    k = F.col("field")
    f = fields(spark, d).select("field", F.when(k % 5 == 0, F.lit(0)).otherwise(F.lit(1)).alias("final"), F.col("open_").alias("writable_outside"), F.when(k % 11 == 0, F.lit(805)).otherwise(F.lit(13)).alias("type_v"), (k % 13 == 0).alias("is_self"))
    return R.external_immutable(f, acc(spark, d).select("field", (F.col("q") % 3 * 8 + 5).alias("v"), ((F.col("n") != 7) | (F.col("q") % 10 == 0)).alias("is_null")))


@query("r04_field_independent", "SELECT s_suppkey AS field, CASE WHEN s_suppkey % 10 = 0 THEN 805 WHEN s_suppkey % 4 = 0 THEN -1 WHEN s_suppkey % 4 = 1 THEN 5 WHEN s_suppkey % 4 = 2 THEN 805 WHEN s_suppkey % 3 = 0 THEN 5 ELSE 1 END AS v FROM supplier")
def r04(spark, d):
    k = F.col("s_suppkey")
    f = t(spark, d, "supplier").select(k.alias("field"), F.get(F.array(*map(F.lit, (-1, 13, 805, 5))), (k % 4).cast("int")).alias("immutable"), (k % 3 == 0).alias("unbound"), F.when(k % 10 == 0, F.lit(805)).otherwise(F.lit(1)).alias("static_v"))
    return R.field_independent(f)


@query("r05_field_container", f"WITH {ACC}, {FIELDS}, s AS (SELECT field, min(CASE WHEN n <= 6 THEN 5 WHEN v = -1 THEN -1 WHEN q > 10 THEN 5 ELSE 1 END) AS least FROM acc GROUP BY 1) SELECT field, CASE WHEN prim THEN 5 WHEN coalesce(least, 1) = -1 THEN -1 ELSE greatest(1, coalesce(least, 1)) END AS v FROM fields LEFT JOIN s USING (field)")
def r05(spark, d):
    f = fields(spark, d).select("field", F.when(F.col("prim"), F.lit(5)).otherwise(F.lit(1)).alias("type_v"))
    return R.field_container(f, acc(spark, d).select("field", F.when(F.col("n") <= 6, F.lit(5)).when(F.col("v") == -1, F.col("v")).when(F.col("q") > 10, F.lit(5)).otherwise(F.lit(1)).alias("v")))


@query("r06_ignore_modifications", f"WITH {ACC}, {FIELDS}, s AS (SELECT field, CASE WHEN min(x) = -1 THEN -1 ELSE max(x) END AS m FROM (SELECT field, CASE WHEN n <= 6 THEN 1 WHEN v = -1 THEN -1 WHEN q > 45 THEN 5 ELSE 1 END AS x FROM acc) GROUP BY 1) SELECT field, CASE WHEN prim THEN 1 WHEN coalesce(m, 1) = -1 THEN -1 WHEN m = 5 THEN 5 ELSE 1 END AS v FROM fields LEFT JOIN s USING (field)")
def r06(spark, d):
    f = fields(spark, d).select("field", F.when(F.col("prim"), F.lit(13)).otherwise(F.lit(1)).alias("immutable"))
    return R.ignore_modifications(f, acc(spark, d).select("field", F.when(F.col("n") <= 6, F.lit(1)).when(F.col("v") == -1, F.col("v")).when(F.col("q") > 45, F.lit(5)).otherwise(F.lit(1)).alias("v")))


@query("r07_field_links", f"WITH {ACC} SELECT field, parameter AS target, CASE WHEN min(v) = -1 THEN -1 ELSE max(v) END AS w FROM acc WHERE parameter % 3 <> 0 AND parameter <> field GROUP BY ALL")
def r07(spark, d):
    return R.field_links(acc(spark, d).select("field", F.col("parameter").alias("target"), F.col("v").alias("w"), F.when(F.col("parameter") % 3 == 0, F.lit("local")).otherwise(F.lit("field")).alias("target_kind")))


@query("r08_field_values", f"WITH {ACC}, {FIELDS}, c AS (SELECT DISTINCT method, method % 25 AS type FROM acc WHERE method % 40 = 1), nc AS (SELECT type, count(DISTINCT method) AS n FROM c GROUP BY 1), a AS (SELECT field, method, q FROM acc WHERE method IN (SELECT method FROM c)), na AS (SELECT field, count(DISTINCT method) AS k FROM a GROUP BY 1) SELECT field, q AS value, 'construction' AS origin FROM a UNION ALL SELECT field, 77, 'initialiser' FROM fields WHERE prim UNION ALL SELECT field, 0, 'default' FROM fields LEFT JOIN nc USING (type) LEFT JOIN na USING (field) WHERE NOT prim AND NOT open_ AND (coalesce(k, 0) < coalesce(n, 0) OR coalesce(n, 0) = 0)")
def r08(spark, d):
    f = fields(spark, d)
    c = acc(spark, d).where("method % 40 = 1").select("method", (F.col("method") % 25).cast("int").alias("type")).distinct()
    return R.field_values(f.select("field", "type", F.col("open_").alias("is_final"), F.lit(0).alias("default")), f.where("prim").select("field", F.lit(77).alias("value")), acc(spark, d).select("field", "method", F.col("q").alias("value")), c)


@query("r09_before_mark", f"WITH {ACC}, {FIELDS}, s AS (SELECT field, CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = -1 THEN -1 ELSE 0 END AS m FROM (SELECT field, CASE WHEN n = 7 THEN v ELSE 0 END AS v FROM acc) GROUP BY 1) SELECT field, CASE WHEN prim OR open_ THEN 0 WHEN m = 1 THEN 0 WHEN m = -1 THEN -1 ELSE 1 END AS v FROM fields LEFT JOIN s USING (field)")
def r09(spark, d):
    f = fields(spark, d).select("field", (~F.col("prim")).alias("eventual"), F.col("open_").alias("exposed"))
    return R.before_mark(f, acc(spark, d).select("field", F.when(F.col("n") == 7, F.col("v")).otherwise(F.lit(0)).alias("is_mark")))


# methods ------------------------------------------------------------------------------------------------------

@query("r10_method_modified", f"WITH {ACC}, m AS (SELECT DISTINCT method FROM acc), a AS (SELECT DISTINCT method FROM acc WHERE n = 6), c AS (SELECT method, CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = -1 THEN -1 ELSE 0 END AS seen FROM (SELECT method, v FROM acc WHERE n <= 3 UNION ALL SELECT method, field % 2 FROM acc WHERE n = 4 AND field % 50 < 2) GROUP BY 1) SELECT method, CASE WHEN method % 30 = 0 OR a.method IS NOT NULL THEN 1 ELSE coalesce(seen, 0) END AS v FROM m LEFT JOIN a USING (method) LEFT JOIN c USING (method)")
def r10(spark, d):
    a = acc(spark, d)
    m = a.select("method").distinct().withColumn("is_ctor", F.col("method") % 30 == 0)
    callee = fields(spark, d).where("field % 50 < 2").select(F.col("field").alias("method"), (F.col("field") % 2).cast("int").alias("v"))
    return R.method_modified(m, a.where("n = 6").select("method"), a.where("n <= 3").select("method", "v"), a.where("n = 4").select(F.col("method").alias("src"), F.col("field").alias("dst")), callee)


@query("r11_return_independent", f"WITH {ACC}, m AS (SELECT DISTINCT method FROM acc), w AS (SELECT method, min(CASE WHEN v = -1 THEN -1 ELSE q % 5 END) AS w FROM acc WHERE n > 3 AND q % 7 <> 0 GROUP BY 1) SELECT method, CASE WHEN method % 9 = 0 OR method % 4 = 2 THEN 805 WHEN w = -1 THEN -1 WHEN w <= 2 THEN 1 WHEN w IS NULL THEN 805 WHEN method % 4 = 0 THEN -1 WHEN method % 4 = 1 THEN 5 ELSE 5 END AS v FROM m LEFT JOIN w USING (method)")
def r11(spark, d):
    a = acc(spark, d)
    m = a.select("method").distinct().select("method", (F.col("method") % 9 == 0).alias("is_void"), F.get(F.array(*map(F.lit, (-1, 13, 805, 5))), (F.col("method") % 4).cast("int")).alias("immutable"))
    return R.return_independent(m, a.where("n > 3").select("method", F.when(F.col("v") == -1, F.col("v")).otherwise(F.col("q") % 5).alias("w"), (F.col("q") % 7 == 0).alias("hidden")))


@query("r12_over_implementations", f"WITH {ACC} SELECT field AS method, p.property, CASE WHEN p.property = 'MODIFIED' THEN CASE WHEN min(v) = -1 THEN -1 ELSE max(v) END ELSE min(v) END AS v FROM acc, (VALUES ('MODIFIED'), ('NOT_NULL')) p(property) GROUP BY field, p.property")
def r12(spark, d):
    a = acc(spark, d).select("field", F.concat_ws(":", "field", "method", "n", "parameter").alias("impl"), "v")
    values = a.select("impl", F.explode(F.array(F.lit("MODIFIED"), F.lit("NOT_NULL"))).alias("property"), "v")
    return R.over_implementations(values, a.select(F.col("field").alias("method"), "impl"))


@query("r13_best_of_overridden", f"WITH {ACC}, m AS (SELECT s_suppkey AS method FROM supplier) SELECT m.method, coalesce(max(CASE WHEN n = 7 AND q > 30 THEN v WHEN n IS NOT NULL THEN -1 END), 0) AS v FROM m LEFT JOIN acc ON field = m.method GROUP BY 1")
def r13(spark, d):
    v = F.when((F.col("n") == 7) & (F.col("q") > 30), F.col("v")).otherwise(F.lit(-1))
    a = acc(spark, d).select("field", F.concat_ws(":", "field", "method", "n", "parameter", "q").alias("other"), v.alias("v"))
    return R.best_of_overridden(fields(spark, d).select(F.col("field").alias("method")), a.select(F.col("field").alias("method"), "other"), a.select("other", "v"), 0)


@query("r14_could_be_static", f"WITH {ACC}, m AS (SELECT DISTINCT method FROM acc WHERE method % 8 <> 0) SELECT method FROM m WHERE method NOT IN (SELECT method FROM acc WHERE n = 5) AND method NOT IN (SELECT method FROM acc WHERE q = 50)")
def r14(spark, d):
    a, no = acc(spark, d), F.lit(False)
    m = a.select("method").distinct().select("method", (F.col("method") % 8 == 0).alias("is_static"), no.alias("is_ctor"), no.alias("overrides"), no.alias("is_default"))
    return R.could_be_static(m, a.where("n = 5").select("method"), a.select("method", (F.col("q") != 50).alias("is_static")))


@query("r15_return_value", f"WITH {ACC}, m AS (SELECT DISTINCT method FROM acc), g AS (SELECT method, bool_and(q > 20) AS th, bool_and(q < 40) AS fi, bool_and(q % 2 = 0) AS co, min(q % 2 * 4 + 1) AS nn FROM acc WHERE n < 4 AND q <> 30 GROUP BY 1) SELECT method, CASE WHEN coalesce(th, false) AND method % 3 <> 0 THEN 1 ELSE 0 END AS fluent, CASE WHEN coalesce(fi, false) AND method % 5 <> 0 THEN 1 ELSE 0 END AS identity, CASE WHEN coalesce(co, false) THEN 1 ELSE 0 END AS constant, coalesce(nn, 5) AS not_null FROM m LEFT JOIN g USING (method)")
def r15(spark, d):
    a, q = acc(spark, d), F.col("q")
    m = a.select("method").distinct().select("method", (F.col("method") % 3 == 0).alias("is_static"), F.lit(True).alias("castable"), (F.col("method") % 5 != 0).alias("first_compatible"))
    return R.return_value(m, a.where("n < 4").select("method", (q > 20).alias("is_this"), (q < 40).alias("is_first_parameter"), (q % 2 == 0).alias("is_constant"), (q % 2 * 4 + 1).alias("v"), (q != 30).alias("reachable")))


@query("r16_call_cycle_decision", f"WITH RECURSIVE {FG}, c(s, e) AS (SELECT src, dst FROM fg UNION SELECT s, dst FROM c JOIN fg ON e = src), m AS (SELECT a.s, min(a.e) AS cyc FROM c a JOIN c b ON a.s = b.e AND a.e = b.s GROUP BY 1), v AS (SELECT src AS method, CASE WHEN src % 6 = 0 THEN -1 WHEN src % 6 = 1 THEN 1 ELSE 0 END AS v, coalesce(cyc, src) AS cyc FROM fg LEFT JOIN m ON s = src), g AS (SELECT cyc, CASE WHEN max(v) = 1 THEN 1 WHEN min(v) = 0 THEN 0 ELSE -1 END AS d FROM v GROUP BY 1) SELECT method, d AS v FROM v JOIN g USING (cyc)")
def r16(spark, d):
    calls = fg(spark, d)
    k = F.col("src") % 6
    return R.call_cycle_decision(calls.select(F.col("src").alias("method"), F.when(k == 0, F.lit(-1)).when(k == 1, F.lit(1)).otherwise(F.lit(0)).alias("v")), calls)


# parameters ---------------------------------------------------------------------------------------------------

@query("r17_parameter_properties", f"WITH {ACC}, o AS (SELECT parameter, CASE WHEN max(x) = 1 THEN 1 WHEN min(x) = -1 THEN -1 ELSE 0 END AS o FROM (SELECT parameter, CASE WHEN v = -1 THEN -1 WHEN field % 20 = 0 THEN 1 ELSE 0 END AS x FROM acc WHERE (CASE WHEN v = -1 THEN -1 ELSE q % 6 END) BETWEEN -1 AND 2) GROUP BY 1), p AS (SELECT p_partkey AS parameter, CASE WHEN p_size = 1 THEN -1 WHEN p_size > 45 THEN 1 ELSE 0 END AS c FROM part) SELECT parameter, CASE WHEN c = 1 OR coalesce(o, 0) = 1 THEN 1 WHEN c = -1 OR coalesce(o, 0) = -1 THEN -1 ELSE 0 END AS modified FROM p LEFT JOIN o USING (parameter)")
def r17(spark, d):
    s = F.col("p_size")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("parameter"), F.when(s == 1, F.lit(-1)).when(s > 45, F.lit(1)).otherwise(F.lit(0)).alias("context_modified"))
    f = fields(spark, d).select("field", F.when(F.col("field") % 20 == 0, F.lit(1)).otherwise(F.lit(0)).alias("modified_outside"))
    return R.parameter_properties(p, f, acc(spark, d).select("parameter", "field", F.when(F.col("v") == -1, F.col("v")).otherwise(F.col("q") % 6).alias("w")))


@query("r18_parameter_independent", f"WITH {ACC}, w AS (SELECT parameter, min(CASE WHEN n <> 7 THEN 100 WHEN v = -1 THEN -1 ELSE q % 6 END) AS w FROM acc GROUP BY 1) SELECT p_partkey AS parameter, CASE WHEN w IS NULL OR w = 100 THEN 805 WHEN w = -1 THEN -1 WHEN w <= 2 THEN 1 ELSE (w - 3) * 8 + 5 END AS v FROM part LEFT JOIN w ON parameter = p_partkey")
def r18(spark, d):
    return R.parameter_independent(t(spark, d, "part").select(F.col("p_partkey").alias("parameter")), acc(spark, d).select("parameter", F.when(F.col("n") != 7, F.lit(100)).when(F.col("v") == -1, F.col("v")).otherwise(F.col("q") % 6).alias("w")))


@query("r19_parameter_from_fields", f"WITH {ACC} SELECT parameter, 'EXTERNAL_NOT_NULL' AS property, CASE WHEN min(x) = -1 THEN -1 ELSE max(x) END AS v FROM (SELECT parameter, CASE WHEN field % 30 = 0 THEN -1 ELSE field % 3 END AS x FROM acc WHERE q % 6 IN (0, 1)) GROUP BY 1")
def r19(spark, d):
    k = F.col("field")
    f = fields(spark, d).select("field", F.lit("EXTERNAL_NOT_NULL").alias("property"), F.when(k % 30 == 0, F.lit(-1)).otherwise((k % 3).cast("int")).alias("v"))
    return R.parameter_from_fields(t(spark, d, "part").select(F.col("p_partkey").alias("parameter")), f, acc(spark, d).select("parameter", "field", (F.col("q") % 6).alias("w")))


# types --------------------------------------------------------------------------------------------------------

@query("r20_all_fields_final", f"WITH {FIELDS}, s AS (SELECT type, CASE WHEN bool_or(v = 0) THEN 0 WHEN bool_or(v = -1) THEN -1 ELSE 1 END AS v FROM (SELECT type, CASE WHEN field % 17 = 0 THEN 0 WHEN field % 7 = 0 THEN -1 ELSE 1 END AS v FROM fields) GROUP BY 1) SELECT n_nationkey AS type, coalesce(v, 1) AS v FROM nation LEFT JOIN s ON type = n_nationkey")
def r20(spark, d):
    k = F.col("field")
    return R.all_fields_final(types(spark, d), fields(spark, d).select("type", "field", F.when(k % 17 == 0, F.lit(0)).when(k % 7 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("v")))


@query("r21_type_container", f"WITH {FIELDS}, s AS (SELECT type, CASE WHEN max(m) = 1 THEN 1 WHEN min(m) = -1 THEN -1 ELSE 0 END AS m FROM (SELECT type, CASE WHEN field % 23 = 0 THEN 1 WHEN field % 11 = 0 THEN -1 ELSE 0 END AS m FROM fields) GROUP BY 1) SELECT n_nationkey AS type, CASE WHEN m = 1 OR n_regionkey = 2 THEN 1 WHEN m = -1 OR n_regionkey = 3 THEN -1 ELSE 5 END AS v FROM nation LEFT JOIN s ON type = n_nationkey")
def r21(spark, d):
    k, g = F.col("field"), F.col("n_regionkey")
    parents = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), F.when(g == 2, F.lit(1)).when(g == 3, F.lit(-1)).otherwise(F.lit(5)).alias("v"))
    return R.type_container(types(spark, d), fields(spark, d).select("type", F.when(k % 23 == 0, F.lit(1)).when(k % 11 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("modified")), parents)


@query("r22_type_independent", f"WITH {FIELDS}, s AS (SELECT type, min(CASE WHEN field % 19 = 0 THEN -1 ELSE field % 3 * 8 + 5 END) AS v FROM fields GROUP BY 1) SELECT n_nationkey AS type, CASE WHEN n_regionkey = 1 THEN 805 ELSE coalesce(v, 805) END AS v FROM nation LEFT JOIN s ON type = n_nationkey")
def r22(spark, d):
    k = F.col("field")
    imm = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), F.when(F.col("n_regionkey") == 1, F.lit(805)).otherwise(F.lit(5)).alias("v"))
    return R.type_independent(types(spark, d), fields(spark, d).select("type", F.when(k % 19 == 0, F.lit(-1)).otherwise(k % 3 * 8 + 5).cast("int").alias("v")), imm)


@query("r23_type_immutable", f"""WITH {FIELDS}, f AS (SELECT type, min(CASE WHEN field % 29 = 0 THEN 0 WHEN field % 13 = 0 THEN -1 ELSE 1 END) AS lo1, bool_or(field % 29 = 0) AS bad1, bool_or(field % 13 = 0 AND field % 29 <> 0) AS del1, bool_or(open_ AND field % 3 = 0) AS bad2 FROM fields GROUP BY 1),
i AS (SELECT type, min(field % 2 * 8 + 5) AS least FROM fields GROUP BY 1),
o AS (SELECT n_nationkey AS type, n_regionkey, CASE WHEN n_regionkey = 4 THEN 1 WHEN n_regionkey = 3 THEN -1 WHEN coalesce(bad1, false) OR coalesce(bad2, false) THEN 5 WHEN coalesce(del1, false) THEN -1 WHEN least IS NULL THEN 805 ELSE 5 + 8 * ((least >> 3) + 1) END AS own FROM nation LEFT JOIN f ON f.type = n_nationkey LEFT JOIN i ON i.type = n_nationkey)
SELECT type, CASE WHEN n_regionkey = 0 THEN least(own, 5) ELSE own END AS v FROM o""")
def r23(spark, d):
    k, g = F.col("field"), F.col("n_regionkey")
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), "n_regionkey")
    e1 = n.select("type", F.when(g == 4, F.lit(0)).when(g == 3, F.lit(-1)).otherwise(F.lit(1)).alias("v"))
    f = fields(spark, d).select("type", F.when(k % 29 == 0, F.lit(1)).when(k % 13 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("modified"), (~F.col("open_")).alias("is_private"), F.when(k % 3 == 0, F.lit(5)).otherwise(F.lit(13)).alias("immutable"), F.lit(False).alias("transparent"))
    ind = fields(spark, d).select("type", (k % 2 * 8 + 5).cast("int").alias("v"))
    return R.type_immutable(types(spark, d), e1, f, ind, n.where("n_regionkey = 0").select("type", F.lit(5).alias("v")), n.limit(0).select("type"))


@query("r24_early_negatives", f"WITH {FIELDS} SELECT DISTINCT type FROM fields WHERE (open_ AND field % 4 = 0) OR field % 37 = 0 OR field % 41 = 0 OR (field % 43 = 0 AND type % 2 = 0)")
def r24(spark, d):
    k, f = F.col("field"), fields(spark, d)
    return R.early_negatives(f.select("type", F.col("open_").alias("exposed"), F.when(k % 4 == 0, F.lit(5)).otherwise(F.lit(13)).alias("immutable")), f.select("type", F.when(k % 37 == 0, F.lit(1)).otherwise(F.lit(5)).alias("independent")), f.select("type", F.when(k % 41 == 0, F.lit(1)).otherwise(F.lit(5)).alias("independent"), F.when(k % 43 == 0, F.lit(1)).otherwise(F.lit(0)).alias("modified")), f.where("type % 2 = 1").select("type"))


@query("r25_utility_class", f"WITH {FIELDS} SELECT n_nationkey AS type FROM nation WHERE n_regionkey < 3 AND NOT EXISTS (SELECT 1 FROM fields WHERE type = n_nationkey AND field % 31 = 0) AND EXISTS (SELECT 1 FROM fields WHERE type = n_nationkey) AND NOT EXISTS (SELECT 1 FROM fields WHERE type = n_nationkey AND field % 23 = 0) AND NOT EXISTS (SELECT 1 FROM fields WHERE type = n_nationkey AND field % 29 = 0)")
def r25(spark, d):
    f, k = fields(spark, d), F.col("field")
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), F.when(F.col("n_regionkey") < 3, F.lit(13)).otherwise(F.lit(5)).alias("immutable"))
    return R.utility_class(n, f.select("type", (k % 31 != 0).alias("is_static")), f.select("type", (k % 23 != 0).alias("is_private")), f.where(k % 29 == 0).select("type"))


@query("r26_extension_class", f"WITH {FIELDS}, g AS (SELECT type, count(DISTINCT field % 2) AS n, max(field % 4) AS most, bool_and(field % 13 <> 0) AS nn FROM fields WHERE NOT open_ AND field % 3 <> 0 GROUP BY 1) SELECT n_nationkey AS type FROM nation JOIN g ON type = n_nationkey WHERE n_regionkey < 4 AND n = 1 AND most > 0 AND nn")
def r26(spark, d):
    f, k = fields(spark, d), F.col("field")
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), F.when(F.col("n_regionkey") < 4, F.lit(10)).otherwise(F.lit(5)).alias("immutable"))
    return R.extension_class(n, f.select("type", (k % 3 != 0).alias("is_static"), F.col("open_").alias("is_private"), (k % 2).alias("first_type"), F.lit(None).cast("long").alias("return_type"), (k % 4).alias("n_params"), (k % 13 != 0).alias("first_not_null")))


@query("r27_singleton", f"WITH {FIELDS}, c AS (SELECT type, bool_and(field % 11 <> 0) AS p, count(*) AS n FROM fields GROUP BY 1), m AS (SELECT type, count(*) FILTER (field % 5 = 0) AS f, count(*) FILTER (field % 97 = 1) AS me FROM fields GROUP BY 1) SELECT n_nationkey AS type FROM nation WHERE n_nationkey IN (SELECT c.type FROM c JOIN m ON c.type = m.type WHERE p AND f = 1 AND me = 0) OR n_nationkey IN (SELECT type FROM c WHERE n = 1 AND type % 2 = 0)")
def r27(spark, d):
    f, k = fields(spark, d), F.col("field")
    made = f.where((k % 5 == 0) | (k % 97 == 1)).select("type", F.explode(F.array_compact(F.array(F.when(k % 5 == 0, F.lit("field")), F.when(k % 97 == 1, F.lit("method"))))).alias("place"), k.alias("elem"))
    return R.singleton(types(spark, d), f.select("type", k.alias("method"), (k % 11 != 0).alias("is_private")), made, f.where("type % 2 = 0").select("type", k.alias("method")))


@query("r28_approved_preconditions", f"WITH {ACC}, c AS (SELECT field, count(*) AS n, count(DISTINCT cond) AS k, count(cond) AS have, min(cond) AS cond FROM (SELECT field, method, CASE WHEN method % 50 < 49 THEN 'c' || (field % 3 * (method % 2)) END AS cond FROM acc GROUP BY field, method HAVING bool_or(n = 7 AND q > 35)) GROUP BY 1) SELECT 1 AS type, field, cond AS condition FROM c WHERE n = have AND k = 1")
def r28(spark, d):
    a = acc(spark, d).groupBy("field", "method").agg(F.bool_or((F.col("n") == 7) & (F.col("q") > 35)).alias("open"))
    cond = F.when(F.col("method") % 50 < 49, F.concat(F.lit("c"), (F.col("field") % 3 * (F.col("method") % 2)).cast("string")))
    good, _ = R.approved_preconditions(a.select(F.lit(1).alias("type"), "method", F.col("field").alias("changes_field"), (~F.col("open")).alias("is_private")), a.select("method", "field", cond.alias("condition")))
    return good


@query("r29_default_immutable", f"WITH {FIELDS}, a AS (SELECT type, min(CASE WHEN field % 47 = 0 THEN -1 ELSE 5 + 8 * (field % 2 + 1) END) AS a FROM fields GROUP BY 1), b AS (SELECT n_nationkey AS type, CASE WHEN n_regionkey = 0 THEN -1 WHEN n_regionkey = 1 THEN 5 ELSE 13 END AS v FROM nation) SELECT b.type AS type_use, CASE WHEN v = -1 OR a = -1 THEN -1 WHEN a IS NULL OR v < 13 THEN v ELSE least(805, (v & 7) + least(100, (v >> 3) + (a >> 3)) * 8) END AS v FROM b LEFT JOIN a USING (type)")
def r29(spark, d):
    k, g = F.col("field"), F.col("n_regionkey")
    own = t(spark, d, "nation").select(F.col("n_nationkey").alias("type_use"), F.when(g == 0, F.lit(-1)).when(g == 1, F.lit(5)).otherwise(F.lit(13)).alias("v"))
    return R.default_immutable(own, fields(spark, d).select(F.col("type").alias("type_use"), F.when(k % 47 == 0, F.lit(-1)).otherwise((k % 2 + 1) * 8 + 5).cast("int").alias("v")))


@query("r30_least_of_parents", "SELECT n_nationkey AS type, CASE n_regionkey WHEN 0 THEN -1 ELSE n_regionkey * 8 + 5 END AS v FROM nation")
def r30(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("type"), F.col("n_regionkey").alias("other"))
    return R.least_of_parents(types(spark, d), n, t(spark, d, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("other"), (F.col("r_regionkey") * 8 + 5).alias("v")), 805)


# entities, links, flow, diagnostics ---------------------------------------------------------------------------

@query("r31_types_referenced", f"WITH {ACC} SELECT method % 100 AS src_type, field AS target_type, bool_or(q > 25) AS explicit FROM acc GROUP BY ALL")
def r31(spark, d):
    refs = acc(spark, d).select((F.col("method") % 100).alias("src_type"), F.array(F.struct(F.col("field").alias("type"), (F.col("q") > 25).alias("explicit"))).alias("targets"))
    return E.types_referenced(refs)


@query("r32_hidden_content", f"WITH {ACC} SELECT DISTINCT method % 50 AS owner, field AS type FROM acc WHERE n = 1 EXCEPT SELECT method % 50, field FROM acc WHERE n = 2")
def r32(spark, d):
    a = acc(spark, d).select((F.col("method") % 50).alias("owner"), F.col("field").alias("type"), "n")
    return E.hidden_content(a.where("n = 1"), a.where("n = 2"))


@query("r33_arguments_to_parameters", f"WITH {ACC} SELECT method AS call_id, method % 3 AS method_fqn, CASE WHEN method % 3 = 1 THEN least(n, 2) ELSE n END AS index, n AS pos FROM acc WHERE (method % 3 = 1) OR n < 3")
def r33(spark, d):
    args = acc(spark, d).select(F.col("method").alias("call_id"), (F.col("method") % 3).alias("method_fqn"), F.col("n").alias("pos"))
    m = spark.createDataFrame([(0, 3, False), (1, 3, True), (2, 3, False)], "method_fqn long, n_params int, is_varargs boolean")
    p = spark.createDataFrame([(k, i, f"p{i}", "T") for k in range(3) for i in range(3)], "method_fqn long, index int, name string, ptype string")
    return E.arguments_to_parameters(args, m, p).select("call_id", "method_fqn", "index", "pos")


@query("r34_lookup_fallback", "SELECT s_suppkey AS elem, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 ELSE -1 END AS v FROM supplier")
def r34(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("elem"))
    return E.lookup(s, s.where("elem % 3 = 0").withColumn("v", F.lit(1)), s.where("elem % 2 = 0").withColumn("v", F.lit(2)))


@query("r35_merge_delay", f"WITH {ACC} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.w = 0 THEN 0 ELSE -1 END AS w FROM (SELECT parameter AS k, min(q % 4) AS w FROM acc WHERE n = 1 GROUP BY 1) a FULL JOIN (SELECT DISTINCT parameter AS k FROM acc WHERE n = 7) b ON a.k = b.k")
def r35(spark, d):
    a = acc(spark, d).select(F.col("parameter").alias("k"), (F.col("q") % 4).alias("w"), "n")
    return K.merge_delay(a.where("n = 1").groupBy("k").agg(F.min("w").alias("w")), a.where("n = 7").select("k", "w"), ["k"])


@query("r36_translate_links", f"WITH {ACC} SELECT field AS src, CASE WHEN parameter % 10 = 0 THEN -(parameter % 100) ELSE parameter END AS dst, min(q % 5) AS w FROM acc GROUP BY ALL")
def r36(spark, d):
    links = acc(spark, d).select(F.col("field").alias("src"), F.col("parameter").alias("dst"), (F.col("q") % 5).alias("w"))
    names = t(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("old"), (-(F.col("p_partkey") % 100)).alias("new"))
    return K.translate(links, names, ["src", "dst"])


@query("r37_compatible_links", f"WITH {ACC}, l AS (SELECT DISTINCT field AS src, parameter AS dst, q % 5 AS w FROM acc), i AS (SELECT *, CASE src % 4 WHEN 0 THEN 13 WHEN 1 THEN -1 ELSE 5 END AS s, CASE dst % 4 WHEN 0 THEN 805 WHEN 1 THEN -1 ELSE 5 END AS t FROM l) SELECT src, dst, CASE WHEN (s = -1 OR t = -1) AND w NOT IN (0, 1) THEN -1 ELSE w END AS w FROM i WHERE w IN (0, 1) OR s = -1 OR t = -1 OR NOT (t = 805 OR (w = 2 AND s >= 13))")
def r37(spark, d):
    links = acc(spark, d).select(F.concat(F.lit("s"), "field").alias("src"), F.concat(F.lit("p"), "parameter").alias("dst"), (F.col("q") % 5).alias("w")).distinct()
    pick = lambda k, a: F.when(k % 4 == 0, F.lit(a)).when(k % 4 == 1, F.lit(-1)).otherwise(F.lit(5)).alias("v")
    imm = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), pick(F.col("s_suppkey"), 13)).union(t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey"), pick(F.col("p_partkey"), 805)))
    out = K.compatible_with_immutable(links, imm)
    return out.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "w")


@query("r38_call_facts", f"WITH RECURSIVE {FG}, i AS (SELECT * FROM fg), c(s, e) AS (SELECT src, dst FROM i UNION SELECT s, dst FROM c JOIN i ON e = src), n AS (SELECT c_custkey AS method FROM customer) SELECT method, (SELECT count(*) FROM c WHERE s = method) AS n_own_reached, EXISTS (SELECT 1 FROM c WHERE s = method AND e = method) AS on_call_cycle, CASE WHEN method % 3 <> 0 THEN 'non_private' WHEN EXISTS (SELECT 1 FROM c WHERE e = method AND s % 3 <> 0 AND s % 7 <> 0) THEN 'called_from_non_private' WHEN EXISTS (SELECT 1 FROM c WHERE e = method AND s % 7 = 0) THEN 'part_of_construction' ELSE 'not_called' END AS status FROM n")
def r38(spark, d):
    k = F.col("id")
    ids = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    m = ids.select(k.alias("method"), F.lit(1).alias("type"), (k % 3 == 0).alias("is_private"), (k % 7 == 0).alias("is_ctor"), F.lit(False).alias("is_static"), F.lit(False).alias("is_abstract"))
    return G.call_facts(fg(spark, d), m).select("method", "n_own_reached", "on_call_cycle", "status")


@query("r39_default_branch", "SELECT conv_id, turn AS block, CASE WHEN role <> 'system' THEN CASE WHEN length(text) > 1500 THEN 2 WHEN length(text) > 100 THEN 1 ELSE 0 END ELSE CASE WHEN m = 2 THEN 0 WHEN coalesce(m, 0) = 0 THEN 2 ELSE 1 END END AS execution FROM (SELECT *, max(CASE WHEN role <> 'system' THEN CASE WHEN length(text) > 1500 THEN 2 WHEN length(text) > 100 THEN 1 ELSE 0 END END) OVER (PARTITION BY conv_id) AS m FROM conversations)")
def r39(spark, d):
    n = F.length("text")
    rows = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("block"), F.when(F.col("role") != "system", F.when(n > 1500, F.lit(2)).when(n > 100, F.lit(1)).otherwise(F.lit(0))).alias("execution"))
    return W.default_branch(rows, ["conv_id"])


@query("r40_copy_forward", "SELECT user_id % 50 AS method_fqn, event_type AS var_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS idx, CAST(event_id AS VARCHAR) AS value FROM events")
def r40(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 50).alias("method_fqn"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("idx"), F.col("event_type").alias("var_id"), F.col("event_id").cast("string").alias("value"))
    moved = W.copy_forward(e.select("method_fqn", "idx").distinct(), e)
    return moved.join(e.select("method_fqn", "var_id", "idx"), ["method_fqn", "var_id", "idx"], "left_semi").select("method_fqn", "var_id", "idx", "value")


@query("r41_never_read", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, max(CASE WHEN event_type <> (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events) WHERE event_type = (SELECT min(event_type) FROM events) AND coalesce(later, 0) = 0")
def r41(spark, d):
    e = t(spark, d, "events")
    write = e.agg(F.min("event_type").alias("write"))
    acts = e.join(F.broadcast(write)).select("user_id", "event_id", "ts", (F.col("event_type") == F.col("write")).alias("assigns"))
    return D.never_read(acts, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("r42_worse_than_overridden", f"WITH {ACC}, v AS (SELECT method AS elem, min(q) AS v FROM acc GROUP BY 1) SELECT a.elem, b.elem AS other, 'P' AS property, a.v, b.v AS other_v FROM v a JOIN v b ON b.elem = a.elem // 2 WHERE a.v < b.v AND a.elem <> b.elem")
def r42(spark, d):
    v = acc(spark, d).groupBy(F.col("method").alias("elem")).agg(F.min("q").alias("v")).withColumn("property", F.lit("P"))
    return D.worse_than_overridden(v, v.select("elem", F.expr("elem div 2").alias("other")).where("elem <> other"))


@query("r43_diagnostic_counts", f"WITH {ACC} SELECT 'WARN' AS severity, 'LOOP_ONCE' AS label, count(*) AS n FROM part WHERE p_size > 10 AND ceil((p_size - 10) / (p_size % 4 + 1)) = 1 UNION ALL SELECT 'ERROR', 'EMPTY_LOOP', count(*) FROM part WHERE p_size <= 10 UNION ALL SELECT 'ERROR', 'DIVISION_BY_ZERO', count(DISTINCT (method, n)) FROM acc WHERE q % 10 = 0")
def r43(spark, d):
    loops = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("method_fqn"), F.lit("0").alias("idx"), W.loop_message(F.lit(10), F.col("p_size"), F.col("p_size") % 4 + 1).alias("message"))
    ops = acc(spark, d).select(F.col("method").cast("string").alias("method_fqn"), F.col("n").cast("string").alias("idx"), F.lit("/").alias("op"), (F.col("q") % 10).cast("string").alias("rhs"))
    return D.counts(D.diagnose({"loops": loops, "binary_ops": ops}))


@query("r44_delay_histogram", f"WITH {DV} SELECT g AS element, count(*) AS n FROM dv WHERE v = -1 GROUP BY 1 ORDER BY n DESC, element LIMIT 20")
def r44(spark, d):
    from graphloom.sources.sinks import delay_histogram

    return delay_histogram(dv(spark, d).where("v = -1").select(F.col("g").alias("element"), (F.col("l_orderkey") % 7).cast("string").alias("cause"))).select("element", "n")


@query("r45_fixpoint_driver", f"WITH RECURSIVE {FG}, m AS (SELECT src, dst FROM fg), r(node) AS (SELECT src FROM m WHERE src % 13 = 0 UNION SELECT src FROM r JOIN m ON node = dst) SELECT CAST(src AS VARCHAR) AS elem, CASE WHEN r.node IS NULL THEN 0 ELSE 1 END AS v FROM m LEFT JOIN r ON r.node = src")
def r45(spark, d):
    from graphloom.plans.fixpoint import run_rules, value_of
    from graphloom.staging import written

    calls = written(fg(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "calls")

    def modified(facts, state, breaking):
        c = facts["calls"]
        known = value_of(state, "MODIFIED", "dst")
        own = c.select("src").distinct().select("src", F.when(F.col("src").cast("int") % 13 == 0, F.lit(1)).alias("own"))
        inside = c.join(c.select(F.col("src").alias("dst")), "dst", "left_semi")
        seen = inside.join(known, "dst", "left").groupBy("src").agg(L.context_modified(F.coalesce("MODIFIED", F.lit(-1))).alias("seen"))
        v = F.coalesce("own", "seen", F.lit(0))
        out = own.join(seen, "src", "left").select(F.col("src").alias("elem"), F.lit("MODIFIED").alias("property"), v.alias("v"))
        return out.withColumn("v", L.replace_delay(F.col("v"), 0)) if breaking else out

    # a value takes a round for each call on the way, and ways are longer in larger tables
    return run_rules({"calls": calls}, [modified], spark, max_rounds=10_000).select("elem", "v")


# calls --------------------------------------------------------------------------------------------------------

@query("r46_value_of_call", f"WITH {ACC}, c AS (SELECT method AS call_id, CASE q % 3 WHEN 0 THEN 'constant' WHEN 1 THEN 'fluent' ELSE 'state' END AS strategy, CASE WHEN n < 6 THEN n END AS value FROM acc), o AS (SELECT *, CASE strategy WHEN 'constant' THEN 5 WHEN 'state' THEN 8 ELSE 10 END AS k FROM c WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k, value) AS i FROM o) SELECT call_id, strategy, value FROM r WHERE i = 1")
def r46(spark, d):
    from graphloom.plans.calls import value_of_call

    q = F.col("q") % 3
    return value_of_call(acc(spark, d).select(F.col("method").alias("call_id"), F.when(q == 0, F.lit("constant")).when(q == 1, F.lit("fluent")).otherwise(F.lit("state")).alias("strategy"), F.when(F.col("n") < 6, F.col("n")).alias("value")))


@query("r47_argument_contexts", f"WITH {ACC}, p AS (SELECT s_suppkey AS method_fqn, CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE s_suppkey % 2 END AS v FROM supplier WHERE s_suppkey % 4 <> 0) SELECT method AS caller, parameter AS var, 'CONTEXT_MODIFIED' AS property, CASE WHEN min(coalesce(p.v, -1)) = -1 THEN -1 ELSE max(p.v) END AS v FROM acc LEFT JOIN p ON method_fqn = field WHERE n < 3 GROUP BY 1, 2")
def r47(spark, d):
    from graphloom.plans.calls import argument_contexts

    k = F.col("field")
    p = fields(spark, d).where(k % 4 != 0).select(k.alias("method_fqn"), F.lit(0).alias("index"), F.lit("CONTEXT_MODIFIED").alias("property"), F.when(k % 9 == 0, F.lit(-1)).otherwise((k % 2).cast("int")).alias("v"))
    return argument_contexts(acc(spark, d).where("n < 3").select(F.col("method").alias("caller"), F.col("parameter").alias("var"), F.col("field").alias("method_fqn"), F.lit(0).alias("index")), p)


@query("r48_call_links", f"WITH {ACC}, i AS (SELECT s_suppkey AS method_fqn, CASE s_suppkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 13 ELSE 805 END AS v FROM supplier), l AS (SELECT method AS caller, field AS src, parameter AS dst, CASE WHEN i.v = -1 THEN -1 WHEN i.v = 805 THEN 100 WHEN i.v = 1 THEN 2 ELSE (i.v >> 3) + 3 END AS w FROM acc JOIN i ON method_fqn = field) SELECT caller, src, dst, min(w) AS w FROM l WHERE w <> 100 GROUP BY ALL")
def r48(spark, d):
    from graphloom.plans.calls import call_links

    k = F.col("field")
    i = fields(spark, d).select(k.alias("method_fqn"), F.lit(0).alias("index"), F.get(F.array(*map(F.lit, (-1, 1, 5, 13, 805))), (k % 5).cast("int")).alias("v"))
    return call_links(acc(spark, d).select(F.col("method").alias("caller"), k.alias("object"), F.col("parameter").alias("var"), k.alias("method_fqn"), F.lit(0).alias("index")), i)
