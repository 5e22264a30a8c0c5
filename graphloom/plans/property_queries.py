"""Property rules and values over inputs shaped like program facts, and their SQL: what :mod:`rule_queries` leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import lattice as L
from graphloom.functions import values as V
from graphloom.plans import rules as R
from graphloom.plans.catalogue import query, t
from graphloom.plans.rule_queries import ACC, acc

def _k():
    return F.col("k")


def _pick(n: int, *values: int):
    """One of the values by k modulo ``n``."""
    return F.get(F.array(*map(F.lit, values)), (_k() % n).cast("int"))


def _sql(n: int, *values: int) -> str:
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def orders(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


ORD = "o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"

# types --------------------------------------------------------------------------------------------------------

@query("rt01_aspects", "SELECT 't' || p_size AS type, 'Size' AS aspect, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def rt01(spark, d):
    from graphloom.operators.entities import companions

    names = t(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey").alias("method_fqn"), F.concat(F.lit("t"), "p_size").alias("type_fqn"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'add$Aspect$Size' ELSE 'add$Value' END").alias("name"))
    return companions(names).where("aspect is not null").groupBy(F.col("type_fqn").alias("type"), "aspect").agg(F.count(F.lit(1)).alias("n"))


@query("rt03_immutable_can_be_increased", f"WITH {ORD} SELECT c AS type, bool_or(k % 7 = 0) AS v FROM o GROUP BY 1")
def rt03(spark, d):
    return R.immutable_can_be_increased(orders(spark, d).select(F.col("c").alias("type"), (_k() % 7 == 0).alias("hidden")))


@query("rt05_duplicate_conditions", f"WITH {ACC} SELECT field % 10 AS type, field FROM (SELECT DISTINCT field, method, 'c' || (method % 2) AS cond FROM acc WHERE method % 9 <> 0) x GROUP BY ALL HAVING count(DISTINCT cond) > 1")
def rt05(spark, d):
    a = acc(spark, d).select("field", "method").distinct()
    _, duplicates = R.approved_preconditions(a.select((F.col("field") % 10).alias("type"), "method", F.col("field").alias("changes_field"), F.lit(False).alias("is_private")), a.where("method % 9 <> 0").select("method", "field", F.concat(F.lit("c"), F.col("method") % 2).alias("condition")))
    return duplicates


@query("rt06_guarded_fields", f"WITH {ORD}, ch AS (SELECT DISTINCT c % 200 AS field, k % 8 AS method FROM o), n AS (SELECT field, count(*) AS n FROM ch GROUP BY 1) SELECT a.field, b.field AS g FROM ch a JOIN ch b ON a.method = b.method AND a.field <> b.field JOIN n ON n.field = a.field WHERE a.field % 2 = 0 AND b.field % 3 = 0 GROUP BY a.field, b.field HAVING count(*) = min(n.n)")
def rt06(spark, d):
    o = orders(spark, d)
    fields = o.select((F.col("c") % 200).alias("field")).distinct()
    return R.guarded_fields(o.select((F.col("c") % 200).alias("field"), (_k() % 8).alias("method")), fields.where("field % 3 = 0"), fields.where("field % 2 = 0"))


@query("rt08_eventual", f"""WITH {ORD}, ty AS (SELECT DISTINCT c AS type FROM o), f AS (SELECT c AS type, bool_or(k % 31 = 0) AS bad, bool_or(k % 37 = 0) AS late FROM o GROUP BY 1), e AS (SELECT type, type % 4 = 0 AS ev, CASE WHEN type % 3 = 0 THEN 0 ELSE 1 END AS e1 FROM ty)
SELECT type, CASE WHEN e1 = 0 AND NOT ev THEN 1 WHEN bad THEN CASE WHEN ev THEN 2 ELSE 5 END WHEN late THEN -1 ELSE CASE WHEN ev THEN 2 ELSE 5 END + 800 END AS v FROM e JOIN f USING (type)""")
def rt08(spark, d):
    o = orders(spark, d).withColumnRenamed("c", "type")
    ty = o.select("type").distinct()
    f = o.select("type", F.when(_k() % 31 == 0, F.lit(1)).when(_k() % 37 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("modified"), F.lit(True).alias("is_private"), F.lit(13).alias("immutable"), F.lit(False).alias("transparent"))
    none = ty.where("false").select("type", F.lit(805).alias("v"))
    return R.type_immutable(ty, ty.select("type", F.when(F.col("type") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("v")), f, none, none, ty.where("type % 4 = 0"))


@query("rt17_ignore_private_constructors", f"WITH {ORD} SELECT c AS type FROM o GROUP BY 1 HAVING bool_or(k % 4 = 0) AND bool_or(k % 4 <> 0) AND NOT bool_or(k % 13 = 0)")
def rt17(spark, d):
    o = orders(spark, d).withColumnRenamed("c", "type")
    return R.ignore_private_constructors(o.select("type", (_k() % 4 == 0).alias("is_private")), o.where("k % 13 = 0").select("type"))


@query("l18_rt18_aggregated_types", f"""WITH {ORD}, r AS (SELECT c % 100 AS type, {_sql(5, -1, 5, 13, 21, 805)} AS v, 't' || (k % 3) AS e, k % 2 = 0 AS tr FROM o) SELECT type, 'IMMUTABLE' AS property, min(v) AS v, string_agg(DISTINCT e, ',' ORDER BY e) AS explicit_types, CASE WHEN bool_and(tr) THEN 'x,y' WHEN bool_or(tr) THEN 'x' ELSE 'x' END AS transparent_types FROM r GROUP BY 1""")
def rt18(spark, d):
    o = orders(spark, d)
    values = o.select(_k().alias("impl"), F.lit("IMMUTABLE").alias("property"), _pick(5, -1, 5, 13, 21, 805).alias("v"), F.array(F.concat(F.lit("t"), _k() % 3)).alias("explicit_types"), F.when(_k() % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("transparent_types"))
    out = R.aggregated_types(values, o.select((F.col("c") % 100).alias("type"), _k().alias("impl")))
    return out.select("type", "property", "v", F.array_join("explicit_types", ",").alias("explicit_types"), F.array_join("transparent_types", ",").alias("transparent_types"))


# fields -------------------------------------------------------------------------------------------------------

@query("rf02_initialisers", f"WITH {ORD} SELECT k AS field, CASE WHEN k % 3 = 0 THEN '<none>' WHEN k % 3 = 1 THEN CAST(c % 5 + k % 10 + 1 AS VARCHAR) ELSE '1+x' END AS value FROM o")
def rf02(spark, d):
    o = orders(spark, d)
    f = o.select(_k().alias("field"), F.col("c").alias("type"), F.when(_k() % 3 == 1, F.concat(F.lit("N+"), _k() % 10 + 1)).when(_k() % 3 == 2, F.lit("x+1")).alias("initialiser"))
    constants = o.select(F.col("c").alias("type"), F.lit("N").alias("name"), (F.col("c") % 5).cast("string").alias("value")).distinct()
    return R.initialiser_values(f, constants)


@query("rf10_final_value", f"WITH {ORD}, v AS (SELECT c AS field, CASE WHEN c % 5 = 0 THEN 'same' ELSE 'v' || (k % 3) END AS value FROM o), g AS (SELECT field, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1) SELECT field, CASE WHEN field % 7 = 0 THEN '<delayed>' WHEN field % 7 = 1 THEN '<variable>' WHEN lo = hi THEN lo ELSE '<multiple>' END AS value FROM g")
def rf10(spark, d):
    o = orders(spark, d).withColumnRenamed("c", "field")
    values = o.select("field", F.when(F.col("field") % 5 == 0, F.lit("same")).otherwise(F.concat(F.lit("v"), _k() % 3)).alias("value"))
    final = o.select("field").distinct().select("field", F.when(F.col("field") % 7 == 0, F.lit(-1)).when(F.col("field") % 7 == 1, F.lit(0)).otherwise(F.lit(1)).alias("v"))
    return R.final_value(values, final)


@query("rf11_constant", f"WITH {ORD}, g AS (SELECT c AS field, count(DISTINCT CASE WHEN c % 5 < 3 THEN 0 ELSE k % 3 END) AS n, bool_and(k % 11 <> 0) AS fine FROM o GROUP BY 1) SELECT field, CASE WHEN field % 7 = 0 OR field % 4 = 0 THEN -1 WHEN field % 7 <> 1 AND n = 1 AND fine AND field % 4 >= 2 THEN 1 ELSE 0 END AS v FROM g")
def rf11(spark, d):
    o = orders(spark, d).withColumnRenamed("c", "field")
    k = F.col("field")
    values = o.select("field", F.when(k % 5 < 3, F.lit(0)).otherwise(_k() % 3).alias("value"), (_k() % 11 != 0).alias("is_constant"))
    ids = o.select("field").distinct()
    final = ids.select("field", F.when(k % 7 == 0, F.lit(-1)).when(k % 7 == 1, F.lit(0)).otherwise(F.lit(1)).alias("v"))
    return R.field_constant(values, final, ids.select("field", F.get(F.array(*map(F.lit, (-1, 5, 13, 805))), (k % 4).cast("int")).alias("v")))


@query("rf16_anonymous_types", f"WITH {ORD}, m AS (SELECT c, {_sql(5, -1, 0, 0, 0, 0)} AS v, k % 47 = 0 AS one FROM o), g AS (SELECT c, CASE WHEN bool_or(one) THEN 1 WHEN min(v) = -1 THEN -1 ELSE 0 END AS v FROM m GROUP BY 1) SELECT s_suppkey AS field, coalesce(v, 0) AS modified FROM supplier LEFT JOIN g ON c = s_suppkey * 20 WHERE s_suppkey % 3 <> 0")
def rf16(spark, d):
    f = t(spark, d, "supplier").select(F.col("s_suppkey").alias("field"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") * 20).alias("initialiser_type"))
    return R.anonymous_initialisers(f, orders(spark, d).select(F.col("c").alias("type"), F.when(_k() % 47 == 0, F.lit(1)).when(_k() % 5 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("modified")))


# methods ------------------------------------------------------------------------------------------------------

@query("rm06_return_immutable", f"WITH {ORD}, v AS (SELECT k, {_sql(4, -1, 5, 13, 1)} AS a, {_sql(3, 5, 13, 21)} AS b FROM o) SELECT k AS method, CASE WHEN k % 9 = 0 THEN 805 WHEN a = -1 THEN -1 ELSE greatest(a, b) END AS v FROM v")
def rm06(spark, d):
    return orders(spark, d).select(_k().alias("method"), R.return_immutable(_pick(4, -1, 5, 13, 1), _pick(3, 5, 13, 21), F.lit(1), F.lit(1), _k() % 9 == 0).alias("v"))


@query("rm07_return_container", f"WITH {ORD}, r AS (SELECT c, min({_sql(6, 1, 5, 5, 5, 5, 5)}) AS least, min(k) AS k FROM o WHERE k % 3 <> 0 GROUP BY 1), m AS (SELECT DISTINCT c FROM o) SELECT m.c AS method, CASE WHEN m.c % 8 = 0 THEN 1 WHEN m.c % 5 = 0 THEN 5 WHEN m.c % 5 = 1 THEN -1 ELSE coalesce(least, 1) END AS v FROM m LEFT JOIN r ON r.c = m.c")
def rm07(spark, d):
    o, c = orders(spark, d), F.col("c")
    m = o.select("c").distinct().select(c.alias("method"), F.when(c % 5 == 0, F.lit(5)).when(c % 5 == 1, F.lit(-1)).otherwise(F.lit(1)).alias("type_v"), (c % 8 == 0).alias("is_void"))
    return R.return_container(m, o.where("k % 3 <> 0").select(c.alias("method"), _pick(6, 1, 5, 5, 5, 5, 5).alias("v")))


@query("rm09_eventual", f"""WITH {ORD}, cl AS (SELECT c AS method, 'f' || (k % 3) AS field, CASE WHEN k % 4 = 0 THEN 'after' ELSE 'before' END AS state FROM o), g AS (SELECT method, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, min(state) AS lo, max(state) AS hi FROM cl GROUP BY 1),
mk AS (SELECT DISTINCT c AS method FROM o WHERE k % 19 = 0) SELECT method, CASE WHEN mk.method IS NOT NULL THEN 'mark' WHEN g.method % 5 = 0 AND g.method % 2 = 1 THEN 'test_mark' WHEN lo <> hi THEN 'conflict' ELSE 'only_' || lo END AS role, fields FROM g LEFT JOIN mk USING (method)""")
def rm09(spark, d):
    o, c = orders(spark, d), F.col("c")
    m = o.select("c").distinct().select(c.alias("method"), (c % 5 == 0).alias("is_boolean"), (c % 2 == 0).alias("modifies"))
    clauses = o.select(c.alias("method"), F.concat(F.lit("f"), _k() % 3).alias("field"), F.when(_k() % 4 == 0, F.lit("after")).otherwise(F.lit("before")).alias("state"))
    return R.eventual(m, clauses, clauses.select("method", "field").join(o.select(c.alias("method"), F.concat(F.lit("f"), _k() % 3).alias("field"), (_k() % 19 == 0).alias("contradicts")), ["method", "field"])).select("method", "role", F.array_join("fields", ",").alias("fields"))


@query("rm11_shallow_modified", f"WITH {ORD}, b AS (SELECT c, max({_sql(7, 1, -1, 0, 0, 0, 0, 0)}) AS best FROM o WHERE k % 2 = 0 GROUP BY 1), m AS (SELECT DISTINCT c FROM o) SELECT m.c AS method, CASE WHEN m.c % 9 < 2 THEN CAST(m.c % 9 AS INTEGER) WHEN m.c % 7 = 0 THEN 1 WHEN best IS NOT NULL THEN best WHEN m.c % 2 = 0 AND (m.c % 3 = 0 OR m.c % 5 = 0) THEN 1 ELSE 0 END AS v FROM m LEFT JOIN b ON b.c = m.c")
def rm11(spark, d):
    o, c = orders(spark, d), F.col("c")
    m = o.select("c").distinct().select(c.alias("method"), F.when(c % 9 < 2, (c % 9).cast("int")).alias("contract"), (c % 7 == 0).alias("is_ctor"), (c % 3 == 0).alias("is_void"), (c % 5 == 0).alias("is_fluent"), (c % 2 == 0).alias("in_container"))
    return R.shallow_modified(m, o.where("k % 2 = 0").select(c.alias("method"), _k().alias("other")), o.select(_k().alias("other"), _pick(7, 1, -1, 0, 0, 0, 0, 0).alias("v")))


# parameters ---------------------------------------------------------------------------------------------------

@query("rp01_first_round", "SELECT p_partkey AS parameter, 'MODIFIED' AS property, p_size % 2 AS v FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'IGNORE_MODS', CASE WHEN p_size % 5 = 0 THEN 1 ELSE 5 END FROM part WHERE p_size % 5 = 0 OR p_size % 4 = 0")
def rp01(spark, d):
    n = F.col("p_size")
    contracts = F.map_from_entries(F.array_compact(F.array(F.when(n % 3 == 0, F.struct(F.lit("MODIFIED").alias("k"), (n % 2).alias("v"))), F.when(n % 5 == 0, F.struct(F.lit("IGNORE_MODS").alias("k"), F.lit(1).alias("v"))))))
    return R.first_round_parameters(t(spark, d, "part").select(F.col("p_partkey").alias("parameter"), F.when(n % 4 == 0, F.lit("java.util.function")).otherwise(F.lit("java.util")).alias("type_package"), contracts.alias("contracts")))


@query("rp06_parameter_container", f"WITH {ORD}, x AS (SELECT c, CASE WHEN max(v) = 5 THEN 5 WHEN min(v) = -1 THEN -1 ELSE 1 END AS ctx FROM (SELECT c, {_sql(11, 5, -1, 1, 1, 1, 1, 1, 1, 1, 1, 1)} AS v FROM o WHERE k % 2 = 0) y GROUP BY 1), f AS (SELECT c, min({_sql(5, 5, 5, 5, 5, 1)}) AS fv FROM o WHERE k % 3 = 0 GROUP BY 1), p AS (SELECT DISTINCT c FROM o) SELECT p.c AS parameter, CASE WHEN p.c % 6 = 0 THEN 5 WHEN ctx = -1 THEN -1 ELSE greatest(coalesce(fv, -2), coalesce(ctx, 1)) END AS v FROM p LEFT JOIN x ON x.c = p.c LEFT JOIN f ON f.c = p.c")
def rp06(spark, d):
    o, c = orders(spark, d), F.col("c")
    p = o.select("c").distinct().select(c.alias("parameter"), F.when(c % 6 == 0, F.lit(5)).otherwise(F.lit(1)).alias("type_v"))
    return R.parameter_container(p, o.where("k % 2 = 0").select(c.alias("parameter"), _pick(11, 5, -1, *[1] * 9).alias("v")), o.where("k % 3 = 0").select(c.alias("parameter"), _pick(5, 5, 5, 5, 5, 1).alias("v")))


@query("rp07_external_immutable", f"WITH {ORD}, f AS (SELECT c, min(CASE WHEN k % 10 = 0 THEN -1 ELSE k % 3 * 8 + 5 END) AS least FROM o WHERE k % 4 = 0 GROUP BY 1), p AS (SELECT DISTINCT c FROM o) SELECT p.c AS parameter, CASE WHEN least IS NULL THEN p.c % 2 * 12 + 1 WHEN least = -1 THEN -1 ELSE greatest(least, p.c % 2 * 12 + 1) END AS v FROM p LEFT JOIN f ON f.c = p.c")
def rp07(spark, d):
    o, c = orders(spark, d), F.col("c")
    p = o.select("c").distinct().select(c.alias("parameter"), (c % 2 * 12 + 1).alias("type_v"))
    return R.parameter_external_immutable(p, o.where("k % 10 <> 0").select(_k().alias("field"), (_k() % 3 * 8 + 5).alias("v")), o.where("k % 4 = 0").select(c.alias("parameter"), _k().alias("field")))


# values -------------------------------------------------------------------------------------------------------

@query("l21_first_any_all", f"WITH {ORD} SELECT c AS g, bool_or(k % 7 = 0) AS any_, bool_and(k % 7 <> 1) AS all_, NOT bool_or(k % 11 = 0) AS none_, min(k) AS first_ FROM o GROUP BY 1")
def l21(spark, d):
    g = orders(spark, d).groupBy(F.col("c").alias("g"))
    return g.agg(L.any_of(_k() % 7 == 0).alias("any_"), L.all_of(_k() % 7 != 1).alias("all_"), L.none_of(_k() % 11 == 0).alias("none_"), L.first_of(_k(), _k()).alias("first_"))


@query("c09_instances", f"WITH {ORD} SELECT k, '<instance T' || (k % 5) || '>' AS value, CASE WHEN k % 2 = 0 THEN 5 ELSE 1 END AS not_null FROM o")
def c09(spark, d):
    v = V.instance(F.concat(F.lit("T"), _k() % 5), F.when(_k() % 2 == 0, F.lit(5)).otherwise(F.lit(1)))
    return orders(spark, d).select("k", v.alias("v")).select("k", "v.value", F.col("v.props")["NOT_NULL"].alias("not_null"))


@query("c10_wrappers", f"WITH {ORD} SELECT k, 'x' AS value, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'true' WHEN k % 2 = 0 THEN 'b' WHEN k % 3 = 0 THEN 'a' ELSE 'a&&b' END AS state, CASE WHEN k % 5 = 0 THEN 13 ELSE 5 END AS not_null, 1 AS modified FROM o")
def c10(spark, d):
    inner = V.wrapped(F.lit("x"), F.when(_k() % 2 != 0, F.lit("a")), F.create_map(F.lit("NOT_NULL"), F.lit(5), F.lit("MODIFIED"), F.lit(1)))
    outer = V.wrapped(F.lit("inner"), F.when(_k() % 3 != 0, F.lit("b")), F.when(_k() % 5 == 0, F.create_map(F.lit("NOT_NULL"), F.lit(13))).otherwise(F.create_map().cast("map<string,int>")))
    rows = orders(spark, d).select("k", inner.alias("i"), outer.alias("o"))
    v = rows.select("k", V.rewrapped(F.col("o"), F.col("i")).alias("v"))
    return v.select("k", "v.value", "v.state", F.col("v.props")["NOT_NULL"].alias("not_null"), F.col("v.props")["MODIFIED"].alias("modified"))


@query("c11_delayed", f"WITH {ORD} SELECT k, CASE WHEN k % 3 = 0 THEN 'x' WHEN k % 2 = 0 THEN '<delayed:a,c' || (k % 4) || '>' ELSE '<delayed:c' || (k % 4) || '>' END AS value, k % 3 <> 0 AS waits FROM o")
def c11(spark, d):
    c = F.concat(F.lit("c"), _k() % 4)
    none = F.array().cast("array<string>")
    v = V.delayed(F.lit("x"), F.when(_k() % 3 == 0, none).when(_k() % 2 == 0, F.array(c, F.lit("a"), c)).otherwise(F.array(c)))
    return orders(spark, d).select("k", v.alias("value")).select("k", "value", V.is_delayed(F.col("value")).alias("waits"))


@query("c12_lists", f"WITH {ORD} SELECT k, 'e' || (k % 6) AS last, '{{a,e' || (k % 6) || '}}' AS both_, CASE WHEN k % 4 = 0 THEN -1 ELSE least(k % 4, 2) END::INTEGER AS not_null, CASE k % 3 WHEN 0 THEN 'a+b' WHEN 1 THEN '(a)+(b)' ELSE '(a+(b))*c' END AS bare FROM o")
def c12(spark, d):
    e = F.array(F.lit("a"), F.concat(F.lit("e"), _k() % 6))
    both = V.several(e, F.array(F.lit(2), F.when(_k() % 4 == 0, F.lit(-1)).otherwise((_k() % 4).cast("int"))))
    text = F.when(_k() % 3 == 0, F.lit("(a+b)")).when(_k() % 3 == 1, F.lit("(a)+(b)")).otherwise(F.lit("((a+(b))*c)"))
    return orders(spark, d).select("k", V.comma(e).alias("last"), both.alias("b"), V.enclosed(text).alias("bare")).select("k", "last", F.col("b.value").alias("both_"), "b.not_null", "bare")


@query("c13_special", f"WITH {ORD} SELECT k, CASE k % 5 WHEN 0 THEN '<unknown:n' || k || '>' WHEN 1 THEN '<empty>' WHEN 2 THEN '<expanded:n' || k || '>' WHEN 3 THEN '@Mark(n' || k || ')' ELSE 'n' || k END AS v FROM o")
def c13(spark, d):
    kind = F.get(F.array(*map(F.lit, ("unknown", "empty", "expanded", "contract", "plain"))), (_k() % 5).cast("int"))
    return orders(spark, d).select("k", V.special(kind, F.concat(F.lit("n"), _k())).alias("v"))


@query("c14_member_values", f"WITH {ORD} SELECT k, CASE WHEN k % 2 = 0 THEN 'a.T' || k ELSE NULL END AS type, CASE WHEN k % 2 = 0 THEN CAST(k % 7 AS VARCHAR) END AS absent, CASE WHEN k % 2 = 1 THEN CAST(k % 7 AS VARCHAR) END AS value FROM o")
def c14(spark, d):
    text = F.when(_k() % 2 == 0, F.concat(F.lit("type = a.T"), _k(), F.lit(".class, absent="), _k() % 7)).otherwise((_k() % 7).cast("string"))
    m = V.member_values(text)
    return orders(spark, d).select("k", m.alias("m")).select("k", *(F.try_element_at("m", F.lit(c)).alias(c) for c in ("type", "absent", "value")))


@query("c15_erasure", f"WITH {ORD} SELECT k, CASE k % 3 WHEN 0 THEN 'Map' WHEN 1 THEN 'List[]' ELSE 'int' END AS v FROM o")
def c15(spark, d):
    kind = F.when(_k() % 3 == 0, F.concat(F.lit("Map<String,List<T"), _k(), F.lit(">>"))).when(_k() % 3 == 1, F.lit("List<? extends A<B<C>>>[]")).otherwise(F.lit("int"))
    return orders(spark, d).select("k", V.erased(kind).alias("v"))


@query("v13_annotations", f"WITH {ORD}, v AS (SELECT k, CASE k % 6 WHEN 0 THEN 'IMMUTABLE' WHEN 1 THEN 'CONTAINER' WHEN 2 THEN 'NOT_NULL' WHEN 3 THEN 'INDEPENDENT' WHEN 4 THEN 'MODIFIED' ELSE 'FINAL' END AS p, CASE k % 7 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 13 WHEN 5 THEN 21 ELSE 805 END AS v FROM o) SELECT k, CASE p WHEN 'IMMUTABLE' THEN CASE v WHEN 5 THEN 'E1Immutable' WHEN 13 THEN 'E2Immutable' WHEN 21 THEN 'E3Immutable' WHEN 805 THEN 'ERContainer' END WHEN 'CONTAINER' THEN CASE v WHEN 5 THEN 'Container' END WHEN 'NOT_NULL' THEN CASE WHEN v >= 5 THEN 'NotNull' WHEN v = 1 THEN 'Nullable' END WHEN 'INDEPENDENT' THEN CASE v WHEN 805 THEN 'Independent' WHEN 1 THEN 'Dependent' WHEN 5 THEN 'Independent1' WHEN 13 THEN 'Independent2' WHEN 21 THEN 'Independent3' END WHEN 'MODIFIED' THEN CASE v WHEN 1 THEN 'Modified' WHEN 0 THEN 'NotModified' END ELSE CASE v WHEN 1 THEN 'Final' WHEN 0 THEN 'Variable' END END AS annotation FROM v")
def v13(spark, d):
    names = F.get(F.array(*map(F.lit, ("IMMUTABLE", "CONTAINER", "NOT_NULL", "INDEPENDENT", "MODIFIED", "FINAL"))), (_k() % 6).cast("int"))
    return orders(spark, d).select("k", R.annotation_of(names, _pick(7, -1, 0, 1, 5, 13, 21, 805)).alias("annotation"))


# several rules together ---------------------------------------------------------------------------------------

@query("r46_rules_together", """WITH RECURSIVE c AS (SELECT c_custkey AS k FROM customer), up(k, a) AS (SELECT k, k FROM c UNION SELECT k, a // 2 FROM up WHERE a > 0), m AS (SELECT k, max(CASE WHEN a % 97 = 3 THEN 1 ELSE 0 END) AS v FROM up GROUP BY 1),
f AS (SELECT s_suppkey AS f, s_suppkey % 25 AS ty, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 1 END AS fin FROM supplier), out AS (SELECT f, ty, fin, CASE WHEN f % 7 = 0 THEN 0 ELSE coalesce((SELECT max(v) FROM m WHERE k % 100 = f), 0) END AS v FROM f),
ty AS (SELECT ty, min(fin) AS fin, max(v) AS v FROM out GROUP BY 1)
SELECT 'm' || k AS elem, 'MODIFIED' AS property, v FROM m UNION ALL SELECT 'f' || f, 'FINAL', fin FROM out UNION ALL SELECT 'f' || f, 'MODIFIED_OUTSIDE', v FROM out UNION ALL SELECT 't' || ty, 'ALL_FINAL', fin FROM ty UNION ALL SELECT 't' || ty, 'IMMUTABLE', CASE WHEN fin = 0 THEN 1 WHEN v = 1 THEN 5 ELSE 805 END FROM ty""")
def r46_rules(spark, d):
    """RF3, RF13, RM2, RT7 and RT8 at their common fixpoint: modification comes up the calls, goes to fields, and from there to types."""
    from graphloom.plans.fixpoint import open_elements, run_rules, value_of
    from graphloom.staging import written

    text = lambda prefix, e: F.concat(F.lit(prefix), F.expr(e))
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    calls = written(c.select(text("m", "c_custkey").alias("elem"), F.expr("CASE WHEN c_custkey > 0 THEN concat('m', c_custkey div 2) END").alias("dst"), (F.col("c_custkey") % 97 == 3).alias("own"), text("f", "c_custkey % 100").alias("reads")), "calls")
    fields = written(s.select(text("f", "s_suppkey").alias("elem"), text("t", "s_suppkey % 25").alias("type"), (F.col("s_suppkey") % 7 == 0).alias("is_primitive"), (F.col("s_suppkey") % 11 == 0).alias("assigned")), "fields")
    named = lambda df, key, prop: df.select(F.col(key).alias("elem"), F.lit(prop).alias("property"), "v")

    def final(facts, state, breaking):
        f = open_elements(facts["fields"], state, "FINAL").select(F.col("elem").alias("field"), F.lit(False).alias("is_final"), F.lit(False).alias("writable_outside"), F.lit(False).alias("is_static"))
        return named(R.field_final(f, facts["fields"].where("assigned").select(F.col("elem").alias("field"), F.lit(True).alias("outside_construction"))), "field", "FINAL")

    def modified(facts, state, breaking):
        own = open_elements(facts["calls"], state, "MODIFIED")
        seen = own.join(value_of(state, "MODIFIED", "dst"), "dst", "left")
        v = F.when(F.col("own"), F.lit(1)).when(F.col("dst").isNull(), F.lit(0)).otherwise(F.coalesce("MODIFIED", F.lit(-1)))
        return seen.select("elem", F.lit("MODIFIED").alias("property"), v.alias("v"))

    def outside(facts, state, breaking):
        f = open_elements(facts["fields"], state, "MODIFIED_OUTSIDE").select(F.col("elem").alias("field"), "is_primitive", F.lit(False).alias("writable_outside"))
        contexts = facts["calls"].join(value_of(state, "MODIFIED", "elem"), "elem", "left").select(F.col("reads").alias("field"), F.coalesce("MODIFIED", F.lit(-1)).alias("v"))
        return named(R.modified_outside(f, contexts, breaking), "field", "MODIFIED_OUTSIDE")

    def types(facts, state):
        return facts["fields"].select("type").distinct()

    def known(facts, state, name):
        return facts["fields"].join(value_of(state, name, "elem"), "elem", "left").select("type", "elem", F.coalesce(name, F.lit(-1)).alias("v"))

    def all_final(facts, state, breaking):
        return named(R.all_fields_final(types(facts, state), known(facts, state, "FINAL")), "type", "ALL_FINAL")

    def immutable(facts, state, breaking):
        ty = types(facts, state)
        e1 = ty.join(value_of(state, "ALL_FINAL", "type"), "type", "left").select("type", F.coalesce("ALL_FINAL", F.lit(-1)).alias("v"))
        f = known(facts, state, "MODIFIED_OUTSIDE").select("type", F.col("v").alias("modified"), F.lit(True).alias("is_private"), F.lit(13).alias("immutable"), F.lit(False).alias("transparent"))
        none = ty.where("false").select("type", F.lit(0).alias("v"))
        return named(R.type_immutable(ty, e1, f, none, none, none.select("type")), "type", "IMMUTABLE")

    return run_rules({"calls": calls, "fields": fields}, [final, modified, outside, all_final, immutable], spark).select("elem", "property", "v")


@query("k07_visitors", """WITH RECURSIVE up(k, a, n) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION SELECT k, a // 2, n + 1 FROM up WHERE a > 0 AND a % 97 <> 3), r AS (SELECT k, max(n) AS r FROM up GROUP BY 1), rounds AS (SELECT unnest(range(0, (SELECT max(r) + 1 FROM r)))::INTEGER AS round)
SELECT 'method' AS kind, 'MODIFIED' AS property, count(*) AS n, count(*) FILTER (r > round) AS delayed, 0::BIGINT AS inconclusive, round FROM rounds, r GROUP BY round""")
def k07(spark, d):
    """A flag that goes down a tree, a step a round, looked at after each round."""
    from graphloom.plans.fixpoint import Visitors, run_rules, value_of
    from graphloom.staging import written

    text = lambda e: F.concat(F.lit("m"), F.expr(e))
    calls = written(t(spark, d, "customer").select(text("c_custkey").alias("elem"), F.expr("CASE WHEN c_custkey > 0 THEN concat('m', c_custkey div 2) END").alias("dst"), (F.col("c_custkey") % 97 == 3).alias("own")), "calls")

    def modified(facts, state, breaking):
        seen = facts["calls"].join(value_of(state, "MODIFIED", "dst"), "dst", "left")
        v = F.when(F.col("own"), F.lit(1)).when(F.col("dst").isNull(), F.lit(0)).otherwise(F.coalesce("MODIFIED", F.lit(-1)))
        return seen.select("elem", F.lit("MODIFIED").alias("property"), v.alias("v"))

    visitors = Visitors(F.when(F.col("elem").startswith("m"), F.lit("method")))
    run_rules({"calls": calls}, [modified], spark, on_round=visitors)
    return visitors.table()
