"""Java sources written from customers, read by the source reader, and SQL for the facts that must come out; types printed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.catalogue import query, t
from graphloom.sources import java as J
from graphloom.sources import sinks as O

C = "c AS (SELECT c_custkey AS k, c_nationkey AS n, 'p' || c_nationkey AS package, 'p' || c_nationkey || '.C' || c_custkey AS fqn FROM customer)"


def sources(spark, d):
    text = """concat('/* ', c_custkey, ' */ package p', c_nationkey, '; import a.b.C', c_custkey % 3, '; import static x.Y.*;
      @Final @Container(absent = true) public abstract class C', c_custkey, '<T extends List<T>> extends C', c_custkey div 2, ' implements I', c_custkey % 5, ', J<T> {
      private final int x = ', c_custkey % 10, ' + f(1, "a;}"), y; C', c_custkey, '(int a, String... b) { if (a < ', c_custkey, ') { } }
      @NotNull protected static <U> List<U> f(@Nullable Map<U, int[]> m) throws E { return null; } // f
      abstract void g(); interface N', c_custkey % 4, ' { int h(); default int i(int j) { return j; } } enum E { A, B(', c_custkey, ') { } } }')"""
    return t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.expr(text).alias("text"))


def facts(spark, d):
    return J.fact_tables(J.declarations(sources(spark, d)))


@query("s03_s05_types", f"WITH {C} SELECT fqn AS type_fqn, package, 'C' || k AS simple_name, 'CLASS' AS nature, 'PUBLIC' AS access, 'C' || (k // 2) AS parent, 'I' || (k % 5) || ';J<T>' AS interfaces, '' AS enclosing, fqn AS primary_type FROM c UNION ALL SELECT fqn || '.N' || (k % 4), package, 'N' || (k % 4), 'INTERFACE', 'PACKAGE', '', '', fqn, fqn FROM c UNION ALL SELECT fqn || '.E', package, 'E', 'ENUM', 'PACKAGE', '', '', fqn, fqn FROM c")
def s03(spark, d):
    none = F.lit("")
    return facts(spark, d)["types"].select("type_fqn", "package", "simple_name", "nature", "access", F.coalesce("parent", none).alias("parent"), F.array_join("interfaces", ";").alias("interfaces"), F.coalesce("enclosing", none).alias("enclosing"), "primary_type")


@query("s05_methods", f"""WITH {C} SELECT fqn || '.C' || k || '(int,String[])' AS method_fqn, true AS is_ctor, false AS is_static, 'PACKAGE' AS access, false AS is_abstract, false AS is_default, '' AS return_type, 2 AS n_params FROM c
  UNION ALL SELECT fqn || '.f(Map<U,int[]>)', false, true, 'PROTECTED', false, false, 'List<U>', 1 FROM c UNION ALL SELECT fqn || '.g()', false, false, 'PACKAGE', true, false, 'void', 0 FROM c
  UNION ALL SELECT fqn || '.N' || (k % 4) || '.h()', false, false, 'PUBLIC', true, false, 'int', 0 FROM c UNION ALL SELECT fqn || '.N' || (k % 4) || '.i(int)', false, false, 'PUBLIC', false, true, 'int', 1 FROM c""")
def s05_methods(spark, d):
    return facts(spark, d)["methods"].select("method_fqn", "is_ctor", "is_static", "access", "is_abstract", "is_default", F.coalesce("return_type", F.lit("")).alias("return_type"), "n_params")


@query("s05_fields", f"""WITH {C} SELECT fqn || '.x' AS field_fqn, 'int' AS ptype, 'PRIVATE' AS access, false AS is_static, true AS is_final, (k % 10) || ' + f ( 1 , "a;}}" )' AS initialiser FROM c UNION ALL SELECT fqn || '.y', 'int', 'PRIVATE', false, true, '' FROM c
  UNION ALL SELECT fqn || '.E.' || v.n, fqn || '.E', 'PUBLIC', true, true, '' FROM c, (VALUES ('A'), ('B')) v(n)""")
def s05_fields(spark, d):
    return facts(spark, d)["fields"].select("field_fqn", "ptype", "access", "is_static", "is_final", F.coalesce("initialiser", F.lit("")).alias("initialiser"))


@query("s05_parameters", f"WITH {C} SELECT fqn || '.C' || k || '(int,String[])' AS method_fqn, v.i AS index, v.n AS name, v.t AS ptype FROM c, (VALUES (0, 'a', 'int'), (1, 'b', 'String[]')) v(i, n, t) UNION ALL SELECT fqn || '.f(Map<U,int[]>)', 0, 'm', 'Map<U,int[]>' FROM c UNION ALL SELECT fqn || '.N' || (k % 4) || '.i(int)', 0, 'j', 'int' FROM c")
def s05_parameters(spark, d):
    return facts(spark, d)["parameters"]


@query("s04_imports_read", f"WITH {C} SELECT CAST(k AS VARCHAR) AS source, 'a.b.C' || (k % 3) AS name, false AS is_star, false AS is_static FROM c UNION ALL SELECT CAST(k AS VARCHAR), 'x.Y', true, true FROM c")
def s04_read(spark, d):
    return facts(spark, d)["imports"]


@query("s12_contracts", "SELECT 'method' AS kind, 'p' || c_nationkey || '.D' || c_custkey || '.f(int)' AS target_fqn, 'NotNull' AS annotation, true AS contracted FROM customer UNION ALL SELECT 'type', 'p' || c_nationkey || '.D' || c_custkey, 'Container', true FROM customer")
def s12(spark, d):
    text = F.expr("concat('package p', c_nationkey, '; @Container public interface D', c_custkey, '$ { @NotNull String f(int a); } class Other { @Modified void g() { } }')")
    rows = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source"), text.alias("text"))
    return J.contracts(J.fact_tables(J.declarations(rows))["annotations"])


@query("k06_print_types", f"""WITH {C} SELECT fqn AS type_fqn, CASE WHEN k % 2 = 0 THEN '@Final ' ELSE '' END || 'class C' || k || ' extends C' || (k // 2) || CASE WHEN k % 3 = 0 THEN ' implements I, J' ELSE '' END || ' {{' || chr(10) || '    @NotNull int f' || CASE WHEN k % 5 = 0 THEN '(' || chr(10) || '            int argument,' || chr(10) || '            java.lang.String other);' ELSE '(int a);' END || chr(10) || '    int x;' || chr(10) || '}}' || chr(10) AS source FROM c""")
def k06(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(k, F.expr("concat('p', c_nationkey, '.C', c_custkey)").alias("type_fqn"))
    none = F.array().cast("array<string>")
    types = c.select("type_fqn", F.concat(F.lit("C"), k).alias("simple_name"), F.lit("CLASS").alias("nature"), F.when(k % 2 == 0, F.array(F.lit("Final"))).alias("annotations"), F.expr("concat('C', c_custkey div 2)").alias("parent"), F.when(k % 3 == 0, F.array(F.lit("I"), F.lit("J"))).otherwise(none).alias("interfaces"))
    methods = c.select("type_fqn", F.array(F.lit("NotNull")).alias("annotations"), F.lit("int").alias("result"), F.lit("f").alias("name"), F.when(k % 5 == 0, F.array(F.lit("int argument"), F.lit("java.lang.String other"))).otherwise(F.array(F.lit("int a"))).alias("parameters"))
    fields = c.select("type_fqn", F.lit(None).cast("array<string>").alias("annotations"), F.lit("int").alias("result"), F.lit("x").alias("name"), F.lit(None).cast("array<string>").alias("parameters"))
    return O.print_types(types, methods.unionByName(fields), width=40)
