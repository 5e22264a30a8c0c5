"""Statement, flow and call operators over statements made from orders (a customer's orders are a method's statements), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans import calls as C
from graphloom.plans import flow as W
from graphloom.plans import statements as N
from graphloom.plans.catalogue import query, t

ST = "st AS (SELECT CAST(o_custkey AS VARCHAR) AS method_fqn, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS idx, o_orderkey AS k, o_custkey AS m FROM orders)"
KEYS = ["method_fqn", "idx"]


def st(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("method_fqn"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("idx"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("m"))


def each(names: str, *rows: tuple, alias: str):
    """Several rows out of each row: their columns' names, and the columns of each."""
    own = names.split()
    return F.explode(F.array(*(F.struct(*(c.alias(n) for n, c in zip(own, r, strict=True))) for r in rows))).alias(alias)


# blocks -------------------------------------------------------------------------------------------------------

_VALUE, _SURE = "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END", "CASE WHEN k % 5 = 0 THEN true END"


def _blocks(name: str, kind: str, *blocks: tuple[str, str, str]) -> None:
    """A query of a statement kind's block executions; ``blocks``: (role, value of the condition, execution as SQL)."""
    sql = " UNION ALL ".join(f"SELECT method_fqn, idx, {n} AS block, {e} AS execution FROM st" for n, (_, _, e) in enumerate(blocks))

    @query(name, f"WITH {ST} {sql}")
    def run(spark, d):
        own = each("block role value", *((F.lit(n), F.lit(role), F.expr(f"CAST({value} AS BOOLEAN)")) for n, (role, value, _) in enumerate(blocks)), alias="b")
        rows = st(spark, d).select(*KEYS, "k", own).select(*KEYS, F.lit(kind).alias("kind"), "b.block", "b.role", "b.value")
        return N.block_executions(rows).select(*KEYS, "block", "execution")


_YES, _NO = "CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END", "CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END"
_blocks("n02_block", "BLOCK", ("body", "NULL", "2"))
_blocks("n06_do", "DO", ("body", _VALUE, "2"))
_blocks("n10_for_each", "FOREACH", ("body", _VALUE, _YES))
_blocks("n11_for", "FOR", ("body", _VALUE, _YES))
_blocks("n12_if_else", "IF_ELSE", ("then", _VALUE, _YES), ("else", _VALUE, _NO))
_blocks("n14_n25_while", "WHILE", ("body", _VALUE, _YES))
_blocks("n19_switch", "SWITCH_NEW", ("entry", _VALUE, _YES), ("entry", _SURE, "CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END"), ("default", "NULL", "CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 0 ELSE 1 END"))
_blocks("n22_synchronized", "SYNCHRONIZED", ("body", "NULL", "2"))
_blocks("n24_try", "TRY", ("main", "NULL", "2"), ("catch", "NULL", "1"), ("finally", "NULL", "2"))


def _interrupt(name: str, kind: str, v: int) -> None:
    @query(name, f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 2 = 0 THEN {v} ELSE 0 END AS interrupt FROM st")
    def run(spark, d):
        return st(spark, d).select(*KEYS, W.interrupt_of(F.when(F.col("k") % 2 == 0, F.lit(kind)).otherwise(F.lit("EXPRESSION"))).alias("interrupt"))


_interrupt("n04_break", "BREAK", 1)
_interrupt("n05_continue", "CONTINUE", 2)
_interrupt("n15_return", "RETURN", 3)
_interrupt("n23_throw", "THROW", 4)


@query("n03_w19_best_interrupt", f"WITH {ST}, r AS (SELECT method_fqn, CAST(k % 3 AS INTEGER) AS interrupt, 'L' || (k % 5) AS label FROM st), b AS (SELECT method_fqn, max(interrupt) AS interrupt FROM r GROUP BY 1) SELECT method_fqn, interrupt, min(label) AS label FROM r JOIN b USING (method_fqn, interrupt) GROUP BY 1, 2")
def n03(spark, d):
    rows = st(spark, d).select("method_fqn", (F.col("k") % 3).cast("int").alias("interrupt"), F.concat(F.lit("L"), F.col("k") % 5).alias("label"))
    return W.best_interrupt(rows, ["method_fqn"])


@query("n16_n18_structure", f"""WITH {ST}, p AS (SELECT method_fqn, idx, 0 AS o, 'initialiser' AS role, 'i=' || k AS expression FROM st WHERE k % 2 = 0 UNION ALL SELECT method_fqn, idx, 1, 'expression', 'i<' || m FROM st WHERE k % 3 <> 0
  UNION ALL SELECT method_fqn, idx, 2, 'updater', 'i++' FROM st UNION ALL SELECT method_fqn, idx, 3, 'updater', 'j++' FROM st) SELECT method_fqn, idx, CAST(row_number() OVER (PARTITION BY method_fqn, idx ORDER BY o) - 1 AS INTEGER) AS pos, role, expression FROM p""")
def n16(spark, d):
    k = F.col("k")
    rows = st(spark, d).select(*KEYS, F.when(k % 2 == 0, F.array(F.concat(F.lit("i="), k))).alias("initialisers"), F.when(k % 3 != 0, F.concat(F.lit("i<"), "m")).alias("expression"), F.array(F.lit("i++"), F.lit("j++")).alias("updaters"))
    return N.structure(rows)


@query("n17_navigation", f"WITH {ST} SELECT method_fqn, idx, lag(idx) OVER w AS previous, lead(idx) OVER w AS next FROM st WINDOW w AS (PARTITION BY method_fqn ORDER BY k)")
def n17(spark, d):
    return W.navigation(st(spark, d), ["method_fqn"], "k").select(*KEYS, "previous", "next")


@query("n20_entry_conditions", f"""WITH {ST}, c AS (SELECT *, (k % 5) || '==x' AS a, (k % 3) || '==x||y==x' AS b FROM st) SELECT method_fqn, idx, 0 AS pos, a AS condition FROM c UNION ALL SELECT method_fqn, idx, 1, b FROM c
  UNION ALL SELECT method_fqn, idx, 2, '!(' || least(a, b) || '||' || greatest(a, b) || ')' FROM c""")
def n20(spark, d):
    text = lambda n: (F.col("k") % n).cast("string")
    entries = each("pos labels", (F.lit(0), F.array(text(5))), (F.lit(1), F.array(text(3), F.lit("y"))), (F.lit(2), F.array().cast("array<string>")), alias="e")
    return N.entry_conditions(st(spark, d).select(*KEYS, "k", entries).select(*KEYS, "e.pos", F.lit("x").alias("selector"), "e.labels"))


@query("n21_fall_through", f"""WITH {ST}, e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'default' ELSE 'L' || (k % 4) END AS label, coalesce(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM st)
SELECT method_fqn, k AS pos, string_agg(label, ',') OVER (PARTITION BY m, g ORDER BY k ROWS UNBOUNDED PRECEDING) AS labels FROM e""")
def n21(spark, d):
    k = F.col("k")
    rows = st(spark, d).select("method_fqn", F.lit("0").alias("idx"), k.alias("pos"), F.when(k % 7 != 0, F.concat(F.lit("L"), k % 4)).alias("label"), (k % 3 == 0).alias("has_break"))
    return N.fall_through(rows).select("method_fqn", "pos", F.array_join("labels", ",").alias("labels"))


@query("n26_yield", f"WITH {ST} SELECT method_fqn, idx, (k % 5) || '==x?' || (k % 7) || ':' || CASE WHEN k % 2 = 0 THEN 'y' ELSE 'null' END AS value FROM st")
def n26(spark, d):
    k = F.col("k")
    entries = each("pos condition value", (F.lit(0), F.concat(F.lit("x=="), k % 5), (k % 7).cast("string")), (F.lit(1), F.lit(None).cast("string"), F.when(k % 2 == 0, F.lit("y"))), alias="e")
    return N.yielded(st(spark, d).select(*KEYS, entries).select(*KEYS, "e.*"))


@query("n08_explicit_constructors", f"""WITH {ST}, ctor AS (SELECT m, k % 3 AS n, min('c' || k) AS ctor FROM st WHERE k % 2 = 0 GROUP BY ALL) SELECT method_fqn, idx, ctor FROM st JOIN ctor ON ctor.n = k % 3 AND ctor.m = CASE WHEN k % 4 < 2 THEN st.m ELSE st.m // 2 END""")
def n08(spark, d):
    rows, k = st(spark, d), F.col("k")
    calls = rows.select(*KEYS, F.concat(F.lit("t"), "m").alias("type_fqn"), F.when(k % 4 < 2, F.lit("this")).otherwise(F.lit("super")).alias("target"), (k % 3).alias("n_args"))
    methods = rows.select(F.concat(F.lit("c"), "k").alias("method_fqn"), F.concat(F.lit("t"), "m").alias("type_fqn"), (k % 2 == 0).alias("is_ctor"), (k % 3).alias("n_params"))
    types = t(spark, d, "customer").select(F.concat(F.lit("t"), "c_custkey").alias("type_fqn"), F.expr("concat('t', c_custkey div 2)").alias("parent"))
    return N.explicit_constructors(calls, methods, types)


_EXPRESSIONS = ("a=1", "a+=2", "++i", "i--", "new T(1)", "f(x)", "x==3", "a[i]>>=2")


@query("n07_n09_effects", f"WITH {ST} SELECT method_fqn, idx, CASE k % 9 WHEN 4 THEN 'create' WHEN 5 THEN 'call' WHEN 6 THEN 'none' WHEN 8 THEN 'none' ELSE 'assign' END AS effect FROM st")
def n09(spark, d):
    texts = F.array(*map(F.lit, _EXPRESSIONS))
    return N.effects(st(spark, d).select(*KEYS, F.get(texts, (F.col("k") % 9).cast("int")).alias("expression"))).select(*KEYS, "effect")


@query("n01_assert", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 20 < 10 THEN 'a>=10' ELSE 'a>=' || (k % 20) END AS after FROM st")
def n01(spark, d):
    return N.state_after_assert(st(spark, d).select(*KEYS, F.concat(F.lit("a>="), F.col("k") % 20).alias("state"), F.lit("a>=10").alias("condition"))).select(*KEYS, "after")


@query("n24_state_after_try", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 'false' WHEN k % 3 = 0 THEN 'e2' WHEN k % 5 = 0 THEN 'e1' ELSE 'e1||e2' END WHEN k % 3 = 0 AND k % 5 = 0 THEN '!e1&&!e2' WHEN k % 3 = 0 THEN '!e1' WHEN k % 5 = 0 THEN '!e2' ELSE 'true' END AS state FROM st")
def n24(spark, d):
    k = F.col("k")
    blocks = each("role condition escapes", (F.lit("main"), F.lit(None).cast("string"), k % 2 == 0), (F.lit("catch"), F.lit("e1"), k % 3 == 0), (F.lit("catch"), F.lit("e2"), k % 5 == 0), alias="b")
    return N.state_after_try(st(spark, d).select(*KEYS, blocks).select(*KEYS, "b.*"))


# variables ----------------------------------------------------------------------------------------------------

@query("c01_read_names", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 3 = 0 THEN 'x$' || (k % 5) WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'x$' || (k % 11) ELSE 'x' END AS name FROM st")
def c01(spark, d):
    k = F.col("k")
    rows = st(spark, d).select(*KEYS, F.lit("x").alias("var_id"), F.when(k % 3 == 0, (k % 5).cast("string")).alias("loop"), (k % 2 == 0).alias("is_field"), (k % 7 == 0).alias("is_final"), (k % 11).alias("time"))
    return N.read_names(rows).select(*KEYS, "name")


@query("c02_assignments", f"""WITH {ST} SELECT method_fqn, idx, CASE k % 6 WHEN 2 THEN 'i' WHEN 3 THEN 'i' WHEN 4 THEN 'return' ELSE 'a' END AS var_id,
  CASE k % 6 WHEN 0 THEN CASE WHEN k = 0 THEN 'b' ELSE k || '+b' END WHEN 1 THEN k || '+a' WHEN 2 THEN '1+i' WHEN 3 THEN '-1+i' WHEN 4 THEN (-k) || '+b' END AS value FROM st WHERE k % 6 < 5""")
def c02(spark, d):
    k = F.col("k")
    text = F.when(k % 6 == 0, F.concat(F.lit("a = b+"), k)).when(k % 6 == 1, F.concat(F.lit("a += "), k)).when(k % 6 == 2, F.lit("i++")).when(k % 6 == 3, F.lit("--i")).when(k % 6 == 4, F.concat(F.lit("b-"), k)).otherwise(F.lit("f(a)==3"))
    return N.assignments(st(spark, d).select(*KEYS, F.when(k % 6 == 4, F.lit("RETURN")).otherwise(F.lit("EXPRESSION")).alias("kind"), text.alias("expression")))


@query("c03_creations", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 3 = 0 THEN 'v$' || idx ELSE 'v' END AS var_id, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) WHEN k % 3 = 0 THEN '<any:v>' ELSE '<none>' END AS value FROM st")
def c03(spark, d):
    k = F.col("k")
    return N.creations(st(spark, d).select(*KEYS, F.lit("v").alias("name"), F.when(k % 2 == 0, k.cast("string")).alias("initialiser"), (k % 3 == 0).alias("in_loop")))


@query("n22_times", f"WITH {ST} SELECT method_fqn, idx, coalesce(sum(CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS time FROM st")
def n22(spark, d):
    k = F.col("k")
    return N.statement_times(st(spark, d).select(*KEYS, F.when(k % 5 == 0, F.lit("SYNCHRONIZED")).otherwise(F.lit("EXPRESSION")).alias("kind"), (k % 3 == 0).alias("modifying_call"))).select(*KEYS, "time")


@query("w02_copy_forward", "WITH e AS (SELECT user_id % 50 AS method_fqn, event_type AS var_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS idx FROM events), v AS (SELECT DISTINCT method_fqn, var_id FROM e) SELECT s.method_fqn, v.var_id, s.idx, max(e.idx) AS value FROM (SELECT DISTINCT method_fqn, idx FROM e) s JOIN v USING (method_fqn) JOIN e ON e.method_fqn = v.method_fqn AND e.var_id = v.var_id AND e.idx <= s.idx GROUP BY ALL")
def w02(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 50).alias("method_fqn"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("idx"), F.col("event_type").alias("var_id"))
    return W.copy_forward(e.select("method_fqn", "idx").distinct(), e.withColumn("value", F.col("idx")))


@query("w03_n13_local_types", f"WITH {ST} SELECT method_fqn, idx, 'L' || (k % 4) AS type_fqn, CASE WHEN m % 3 <> 0 THEN 'T' || (m % 10) END AS primary_type FROM st WHERE k % 2 = 0 UNION SELECT method_fqn, idx, 'A' || k, CASE WHEN m % 3 <> 0 THEN 'T' || (m % 10) END FROM st WHERE k % 2 = 0")
def w03(spark, d):
    k = F.col("k")
    rows = st(spark, d).select(*KEYS, F.when(k % 2 == 0, F.array(F.concat(F.lit("L"), k % 4), F.concat(F.lit("A"), k), F.concat(F.lit("L"), k % 4))).alias("declares"))
    types = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("method_fqn"), F.concat(F.lit("T"), F.col("c_custkey") % 10).alias("primary_type"))
    return N.local_types(rows, types)


@query("w04_evaluate_main", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 10 = 0 THEN '' ELSE (k % 10) || '+' END || '2*' || CASE WHEN k % 3 = 0 THEN 'z' ELSE 'y' END AS value FROM st")
def w04(spark, d):
    k = F.col("k")
    rows = st(spark, d)
    values = each("var_id value", (F.lit("x"), (k % 10).cast("string")), (F.lit("y"), F.when(k % 3 == 0, F.lit("z")).otherwise(F.lit("<unknown>"))), alias="v")
    return N.evaluate_main(rows.select(*KEYS, F.lit("x+y*2").alias("expression")), rows.select(*KEYS, values).select(*KEYS, "v.*")).select(*KEYS, "value")


@query("w05_apply_evaluation", f"""WITH {ST}, s AS (SELECT DISTINCT method_fqn, m, 'v' || n AS var_id, n FROM st, (VALUES (0), (1), (2)) x(n)), r AS (SELECT method_fqn, 'v' || (k % 4) AS var_id, max(idx) AS idx FROM st GROUP BY ALL)
SELECT coalesce(s.method_fqn, r.method_fqn) AS method_fqn, coalesce(s.var_id, r.var_id) AS var_id, coalesce('new' || r.idx, 'old') AS value, CASE WHEN s.var_id IS NULL THEN r.idx WHEN r.idx IS NULL THEN '0' ELSE '0,' || r.idx END AS assign_ids FROM s FULL JOIN r ON s.method_fqn = r.method_fqn AND s.var_id = r.var_id""")
def w05(spark, d):
    rows = st(spark, d)
    state = rows.select("method_fqn").distinct().select("method_fqn", F.explode(F.array(*map(F.lit, ("v0", "v1", "v2")))).alias("var_id"), F.lit("old").alias("value"), F.array(F.lit("0")).alias("assign_ids"))
    results = rows.groupBy("method_fqn", F.concat(F.lit("v"), F.col("k") % 4).alias("var_id")).agg(F.max("idx").alias("idx")).withColumn("value", F.concat(F.lit("new"), "idx"))
    # '0' sorts before all other ids
    return N.apply_evaluation(state, results).select("method_fqn", "var_id", "value", F.array_join("assign_ids", ",").alias("assign_ids"))


@query("w06_state_after_if", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'false' WHEN k % 2 = 0 THEN '!(a>' || k || ')' WHEN k % 3 = 0 THEN 'a>' || k ELSE 'true' END AS state FROM st")
def w06(spark, d):
    k = F.col("k")
    return st(spark, d).select(*KEYS, W.state_after_if(F.concat(F.lit("a>"), k), k % 2 == 0, k % 3 == 0).alias("state"))


@query("w07_merge_values", f"""WITH {ST}, b AS (SELECT *, 'v' || (k % 3) AS v1, 'v' || (k % 2) AS v2 FROM st) SELECT method_fqn, idx, CASE k % 4 WHEN 0 THEN CASE WHEN v1 = 'v2' THEN 'v2' ELSE 'c?' || v1 || ':v2' END WHEN 1 THEN CASE WHEN v1 = v2 THEN v1 ELSE 'c?' || v1 || ':' || v2 END WHEN 2 THEN v2
  ELSE CASE WHEN v1 = v2 AND v1 = 'v2' THEN 'v2' ELSE '<unknown>' END END AS value, k % 4 <> 3 OR (v1 = v2 AND v1 = 'v2') AS exact FROM b""")
def w07(spark, d):
    k = F.col("k")
    v1, v2, kind = F.concat(F.lit("v"), k % 3), F.concat(F.lit("v"), k % 2), k % 4
    branch = lambda pos, cond, v, last: F.struct(F.lit(pos).alias("pos"), cond.alias("cond"), v.alias("value"), F.lit("v2").alias("old"), last.alias("unconditional"))
    no, c = F.lit(False), F.lit("c")
    one, two = branch(0, c, v1, no), branch(1, F.when(kind == 1, F.lit("!c")).otherwise(F.lit("d")), v2, kind == 2)
    branches = F.explode(F.when(kind == 0, F.array(one)).otherwise(F.array(one, two))).alias("b")
    return W.merge_values(st(spark, d).select(*KEYS, "k", branches).select(*KEYS, "b.*"), KEYS)


@query("w09_loop_assignments", f"WITH {ST}, l AS (SELECT method_fqn, idx AS loop FROM st WHERE k % 7 = 0), a AS (SELECT method_fqn, idx || '.0.' || n AS idx, 'v' || n AS var_id FROM st, (VALUES (0), (1)) x(n)) SELECT DISTINCT l.method_fqn, loop, var_id FROM l JOIN a ON a.method_fqn = l.method_fqn AND starts_with(a.idx, loop || '.')")
def w09(spark, d):
    rows = st(spark, d)
    inside = rows.select("method_fqn", "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("method_fqn", F.concat("idx", F.lit(".0."), "n").alias("idx"), F.concat(F.lit("v"), "n").alias("var_id"))
    return W.assigned_in_loops(inside, rows.where("k % 7 = 0").select("method_fqn", "idx"))


@query("w10_rm4_method_level", f"WITH {ST} SELECT method_fqn, string_agg(DISTINCT 'a>' || (k % 6), ';' ORDER BY 'a>' || (k % 6)) AS clauses FROM st GROUP BY 1")
def w10(spark, d):
    return W.method_level(st(spark, d).select("method_fqn", F.concat(F.lit("a>"), F.col("k") % 6).alias("clause"))).select("method_fqn", F.array_join("clauses", ";").alias("clauses"))


_UP = "up(block, node) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT block, node // 2 FROM up WHERE node > 0)"


@query("w16_absolute_state", f"WITH RECURSIVE {_UP} SELECT block, string_agg(DISTINCT 'a>' || (node % 4), ';' ORDER BY 'a>' || (node % 4)) AS clauses FROM up GROUP BY 1")
def w16(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("block"), F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 2 END").alias("parent"))
    return W.absolute_state(c.select("block", F.concat(F.lit("a>"), F.col("block") % 4).alias("clause")), c).select("block", F.array_join("clauses", ";").alias("clauses"))


@query("w08_execution_down", f"WITH RECURSIVE {_UP} SELECT block, min(CASE WHEN node % 17 = 5 THEN 0 WHEN node % 5 = 3 THEN 1 ELSE 2 END) AS execution FROM up GROUP BY 1")
def w08(spark, d):
    k = F.col("block")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("block"), F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 2 END").alias("parent"))
    return W.execution_down(c.withColumn("execution", F.when(k % 17 == 5, F.lit(0)).when(k % 5 == 3, F.lit(1)).otherwise(F.lit(2))))


@query("w15_from_closures", f"WITH {ST}, r AS (SELECT method_fqn, m, 'v' || (k % 3) AS var_id, k % 2 AS v FROM st), o AS (SELECT CASE WHEN m % 2 = 1 THEN CAST(m // 2 AS VARCHAR) ELSE method_fqn END AS method_fqn, var_id, v FROM r WHERE NOT (m % 2 = 1 AND var_id = 'v2')) SELECT method_fqn, var_id, max(v) AS v FROM o GROUP BY ALL")
def w15(spark, d):
    r = st(spark, d).select("method_fqn", F.concat(F.lit("v"), F.col("k") % 3).alias("var_id"), (F.col("k") % 2).alias("v"))
    inner = t(spark, d, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").cast("string").alias("method_fqn"), F.expr("CAST(c_custkey div 2 AS STRING)").alias("outer"))
    return N.from_closures(r, inner, inner.select("method_fqn", F.lit("v2").alias("var_id")))


@query("w17_loop_exit", "SELECT p_partkey, CAST(CASE WHEN p_size > 10 THEN 10 + ceil((p_size - 10) / (p_size % 4 + 1)) * (p_size % 4 + 1) ELSE 10 END AS BIGINT) AS last FROM part")
def w17(spark, d):
    return t(spark, d, "part").select("p_partkey", W.loop_exit(F.lit(10), F.col("p_size"), F.col("p_size") % 4 + 1).cast("long").alias("last"))


# calls --------------------------------------------------------------------------------------------------------

@query("c08_inlined", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 5 = 0 THEN 'a' ELSE (k % 5) || '+a' END AS inlined FROM st")
def c08(spark, d):
    rows = st(spark, d).select(*KEYS, F.lit("x+y").alias("body"), F.array(F.lit("x"), F.lit("y")).alias("names"), F.array(F.lit("a"), (F.col("k") % 5).cast("string")).alias("arguments"))
    return C.inlined(rows).select(*KEYS, "inlined")


@query("c16_renamed", f"""WITH {ST} SELECT method_fqn, idx, 'b' || k || '>a&&f("a")==c' AS clause FROM st""")
def c16(spark, d):
    names = F.create_map(F.lit("a"), F.concat(F.lit("b"), "k"), F.lit("b"), F.lit("a"))
    return st(spark, d).select(*KEYS, C.renamed(F.lit('a>b&&f("a")==c'), names).alias("clause"))


@query("c07_dynamic_immutable", f"WITH {ST} SELECT method_fqn, idx, CASE WHEN k % 4 = 0 OR k % 3 = 0 THEN -1 ELSE greatest(k % 4 * 8 + 5, k % 3 * 8 + 5)::INTEGER END AS v FROM st")
def c07(spark, d):
    k = F.col("k")
    v = lambda n: F.when(k % n == 0, F.lit(-1)).otherwise((k % n * 8 + 5).cast("int"))
    return st(spark, d).select(*KEYS, C.dynamic_immutable(v(4), v(3)).alias("v"))


@query("s07_descriptors", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'java.lang.String[]' WHEN 2 THEN 'double[][],a.B$C' ELSE '' END AS arguments, CASE WHEN p_size % 2 = 0 THEN 'void' ELSE 'a.B' END AS returns FROM part")
def s07(spark, d):
    n = F.col("p_size") % 4
    args = F.when(n == 0, F.lit("I")).when(n == 1, F.lit("[Ljava/lang/String;")).when(n == 2, F.lit("[[DLa/B$C;")).otherwise(F.lit(""))
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("("), args, F.lit(")"), F.when(F.col("p_size") % 2 == 0, F.lit("V")).otherwise(F.lit("La/B;"))).alias("descriptor"))
    return C.descriptor_types(rows).select("p_partkey", F.array_join("arguments", ",").alias("arguments"), "returns")


# whole methods ------------------------------------------------------------------------------------------------

@query("rm1_w01_analyse_statements", """WITH c AS (SELECT 'm' || c_custkey AS method_fqn, c_custkey % 50 AS x, CASE WHEN c_custkey % 50 > 25 THEN 1 ELSE 2 END AS y, c_custkey % 7 AS p FROM customer)
SELECT method_fqn, '0' AS idx, 2 AS reached, 'true' AS state, CAST(x AS VARCHAR) AS value FROM c
UNION ALL SELECT method_fqn, '1', 2, 'true', CASE WHEN x > 25 THEN 'true' ELSE 'false' END FROM c
UNION ALL SELECT method_fqn, '1.0.0', CASE WHEN x > 25 THEN 2 ELSE 0 END, CASE WHEN x > 25 THEN 'true' ELSE 'false' END, '1' FROM c
UNION ALL SELECT method_fqn, '1.1.0', CASE WHEN x > 25 THEN 0 ELSE 2 END, CASE WHEN x > 25 THEN 'false' ELSE 'true' END, '2' FROM c
UNION ALL SELECT method_fqn, '2', 2, 'true', 'p>=' || (p + 1) FROM c
UNION ALL SELECT method_fqn, '2.0.0', 1, 'p>=' || (p + 1), CAST(x + y AS VARCHAR) FROM c
UNION ALL SELECT method_fqn, '3', 1, 'p<=' || p, y || '+p' FROM c
UNION ALL SELECT method_fqn, '4', 1, 'p<=' || p, 'q>=1' FROM c
UNION ALL SELECT method_fqn, '4.0.0', 1, 'p<=' || p || '&&q>=1', '1+z$4' FROM c
UNION ALL SELECT method_fqn, '5', 1, 'p<=' || p || '&&q<=0', y || '+p' FROM c
UNION ALL SELECT method_fqn, '6', 0, 'p<=' || p || '&&q<=0', '7' FROM c
UNION ALL SELECT method_fqn, 'return', 0, 'p<=' || p || '&&q<=0', 'p>=' || (p + 1) || '?' || (x + y) || ':' || y || '+p' FROM c
UNION ALL SELECT method_fqn, 'end:x', 0, 'p<=' || p || '&&q<=0', '7' FROM c
UNION ALL SELECT method_fqn, 'end:y', 0, 'p<=' || p || '&&q<=0', y || '+p' FROM c
UNION ALL SELECT method_fqn, 'end:z', 0, 'p<=' || p || '&&q<=0', 'z$4' FROM c""")
def rm1(spark, d):
    k = F.col("c_custkey")
    row = lambda idx, kind, target, expression: F.struct(F.lit(idx).alias("idx"), F.lit(kind).alias("kind"), F.lit(target).cast("string").alias("target"), (expression if not isinstance(expression, str) else F.lit(expression)).alias("expression"))
    said = F.array(
        row("0", "EXPRESSION", "x", (k % 50).cast("string")), row("1", "IF_ELSE", None, "x>25"), row("1.0.0", "EXPRESSION", "y", "1"), row("1.1.0", "EXPRESSION", "y", "2"), row("2", "IF_ELSE", None, F.concat(F.lit("p>"), k % 7)), row("2.0.0", "RETURN", None, "y+x"),
        row("3", "EXPRESSION", "y", "y+p"), row("4", "WHILE", None, "q>0"), row("4.0.0", "EXPRESSION", "z", "z+1"), row("5", "RETURN", None, "y"), row("6", "EXPRESSION", "x", "7"),
    )
    rows = t(spark, d, "customer").select(F.concat(F.lit("m"), k).alias("method_fqn"), F.explode(said).alias("s")).select("method_fqn", "s.*")
    return N.analyse_statements(rows)
