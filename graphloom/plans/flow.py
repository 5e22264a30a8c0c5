"""Statement flow: order in blocks, reachability, interrupts, loops, conditions and merged branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lattice import EXECUTION, INTERRUPT
from graphloom.operators.graph import closure

#: Statement kinds and what they do to flow.
STATEMENTS = {
    "ASSERT": "filter", "BLOCK": "block", "BREAK": "break", "CONTINUE": "continue", "DO": "loop_once", "EMPTY": "none",
    "EXPLICIT_CONSTRUCTOR_CALL": "call", "EXPRESSION": "effect", "FOREACH": "loop", "FOR": "loop", "IF_ELSE": "branch",
    "LOCAL_CLASS": "declaration", "RETURN": "return", "SWITCH_ENTRY": "branch", "SWITCH_NEW": "branch", "SWITCH_OLD": "fall_through",
    "SYNCHRONIZED": "block", "THROW": "escape", "TRY": "branch", "WHILE": "loop", "YIELD": "value",
}


def interrupt_of(kind: Column) -> Column:
    """The interrupt that a statement's kind raises by itself."""
    own = [(k, INTERRUPT[v]) for k, v in STATEMENTS.items() if v in INTERRUPT]
    return F.coalesce(F.create_map(*(F.lit(x) for kv in own for x in kv))[kind], F.lit(INTERRUPT["no"]))


def navigation(statements: DataFrame, block: list[str], pos: str = "pos") -> DataFrame:
    """Each statement with its neighbours in the block: previous and next, null at the ends."""
    order = Window.partitionBy(*block).orderBy(pos)
    return statements.withColumn("previous", F.lag("idx").over(order)).withColumn("next", F.lead("idx").over(order))


def reachability(statements: DataFrame, block: list[str], pos: str) -> DataFrame:
    """With ``reached``: the least of what all statements before it in the block let through (``after``); the first is always reached."""
    before = Window.partitionBy(*block).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return statements.withColumn("reached", F.coalesce(F.min("after").over(before), F.lit(EXECUTION["ALWAYS"])))


def execution_down(blocks: DataFrame) -> DataFrame:
    """(block, execution) with the least execution of a block and all around it. ``blocks``: block, parent, execution."""
    up = closure(blocks.where("parent is not null").select(F.col("block").alias("src"), F.col("parent").alias("dst")), blocks.select("block"))
    return up.join(blocks.select(F.col("block").alias("node"), "execution"), "node").groupBy(F.col("start").alias("block")).agg(F.min("execution").alias("execution"))


def merge_interrupts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interrupt, v): per kind the most over the blocks, then no more than the statement is executed."""
    each = rows.groupBy(*keys, "interrupt").agg(F.max("v").alias("v"), F.max("execution").alias("execution"))
    return each.select(*keys, "interrupt", F.least("v", "execution").alias("v"))


def best_interrupt(kinds: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest interrupt, and its label; ties to the smaller label."""
    return kinds.groupBy(*keys).agg(F.min_by(F.struct("interrupt", "label"), F.struct(-F.col("interrupt"), "label")).alias("b")).select(*keys, "b.interrupt", "b.label")


def default_branch(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Executions of sub-blocks; one without a condition (``execution`` null) runs if no other surely does: (keys, block, execution)."""
    most = Window.partitionBy(*keys)
    rest = F.when(F.max("execution").over(most) == EXECUTION["ALWAYS"], F.lit(EXECUTION["NEVER"])).when(F.coalesce(F.max("execution").over(most), F.lit(0)) == EXECUTION["NEVER"], F.lit(EXECUTION["ALWAYS"])).otherwise(F.lit(EXECUTION["CONDITIONALLY"]))
    return branches.select(*keys, "block", F.coalesce("execution", rest).alias("execution"))


def state_after_if(cond: Column, then_escapes: Column, else_escapes: Column) -> Column:
    """What is known after an if: both escape, nothing; the then-branch, the negated condition; the else-branch, the condition."""
    return F.when(then_escapes & else_escapes, F.lit("false")).when(then_escapes, F.concat(F.lit("!("), cond, F.lit(")"))).when(else_escapes, cond).otherwise(F.lit("true"))


def merge_values(branches: DataFrame, keys: list[str]) -> DataFrame:
    """A variable's value after branches: (keys, value, exact).

    ``branches``: keys, pos, cond, value, old, unconditional. The last unconditional branch decides; equal values stay;
    one branch gives ``cond?new:old``, two complementary ones (``cond`` and ``!cond``) ``cond?a:b``; else nothing exact is known.
    """
    g = branches.groupBy(*keys).agg(
        F.max_by("value", F.when(F.col("unconditional"), F.col("pos"))).alias("last"), F.bool_or("unconditional").alias("decided"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.min_by("cond", "pos").alias("c1"), F.min_by("value", "pos").alias("v1"), F.max_by("cond", "pos").alias("c2"), F.max_by("value", "pos").alias("v2"), F.min_by("old", "pos").alias("old"),
    )
    text = F.when(F.col("decided"), F.col("last")).when((F.col("n") == 1) & (F.col("v1") == F.col("old")), F.col("old")).when(F.col("n") == 1, F.concat("c1", F.lit("?"), "v1", F.lit(":"), "old"))
    text = text.when((F.col("n") == 2) & (F.col("c2") == F.concat(F.lit("!"), F.col("c1"))), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.concat("c1", F.lit("?"), "v1", F.lit(":"), "v2"))).when((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("old")), F.col("lo"))
    return g.select(*keys, F.coalesce(text, F.lit("<unknown>")).alias("value"), text.isNotNull().alias("exact"))


def absolute_state(conditions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, clauses): the conditions of a block and of all around it, for a conjunction. ``conditions``: block, clause; ``blocks``: block, parent."""
    up = closure(blocks.where("parent is not null").select(F.col("block").alias("src"), F.col("parent").alias("dst")), blocks.select("block"))
    return up.join(conditions.select(F.col("block").alias("node"), "clause"), "node").groupBy(F.col("start").alias("block")).agg(F.array_sort(F.collect_set("clause")).alias("clauses"))


def copy_forward(statements: DataFrame, assigned: DataFrame, method: str = "method_fqn") -> DataFrame:
    """(method, var_id, idx, value): each variable's latest value at or before each statement, by string order of indices."""
    per = statements.join(assigned.select(method, "var_id").distinct(), method)
    rows = per.join(assigned, [method, "var_id", "idx"], "left")
    upto = Window.partitionBy(method, "var_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(method, "var_id", "idx", F.last("value", ignorenulls=True).over(upto).alias("value")).where("value is not null")


def assigned_in_loops(assigned: DataFrame, loops: DataFrame) -> DataFrame:
    """(method_fqn, loop, var_id) of variables that a loop's body assigns; a body's indices start with the loop's and a dot."""
    return assigned.join(loops.select("method_fqn", F.col("idx").alias("loop")), "method_fqn").where(F.col("idx").startswith(F.concat("loop", F.lit(".")))).select("method_fqn", "loop", "var_id").distinct()


def method_level(preconditions: DataFrame) -> DataFrame:
    """(method_fqn, clauses): a method's preconditions together."""
    return preconditions.groupBy("method_fqn").agg(F.array_sort(F.collect_set("clause")).alias("clauses"))


def loop_count(start: Column, end_excl: Column, inc: Column) -> Column:
    """How often a counting loop runs; never below 0."""
    return F.greatest(F.ceil((end_excl - start) / inc), F.lit(0)).cast("long")


def loop_message(start: Column, end_excl: Column, inc: Column) -> Column:
    """EMPTY_LOOP, INFINITE_LOOP_CONDITION or LOOP_ONCE, else null."""
    return (
        F.when(inc == 0, F.when(start < end_excl, F.lit("INFINITE_LOOP_CONDITION")).otherwise(F.lit("EMPTY_LOOP")))
        .when(((inc > 0) & (start >= end_excl)) | ((inc < 0) & (start <= end_excl)), F.lit("EMPTY_LOOP"))
        .when(loop_count(start, end_excl, inc) == 1, F.lit("LOOP_ONCE"))
    )


def loop_exit(start: Column, end_excl: Column, inc: Column) -> Column:
    """The counter's value after the loop."""
    return start + loop_count(start, end_excl, inc) * inc
