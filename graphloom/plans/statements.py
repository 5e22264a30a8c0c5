"""Statements by kind: their parts, how often their blocks run, what they do to state, and whole methods walked through.

Tables hold one row per statement (method_fqn, idx, kind, ...); idx is dotted, ``2.0.1`` being statement 1 in block 0 of
statement 2. All operators but :func:`analyse_statements` and the symbolic columns are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lattice import EXECUTION

NEVER, CONDITIONALLY, ALWAYS = EXECUTION["NEVER"], EXECUTION["CONDITIONALLY"], EXECUTION["ALWAYS"]
#: Statements whose blocks run whenever they do, and loops whose body follows a condition.
PLAIN, LOOPS = ("BLOCK", "SYNCHRONIZED", "DO"), ("WHILE", "FOR", "FOREACH")


def structure(statements: DataFrame) -> DataFrame:
    """(method_fqn, idx, pos, role, expression): a statement's expressions as they are evaluated: initialisers, the expression itself, updaters.

    ``statements``: method_fqn, idx, initialisers (array), expression, updaters (array); nulls are no expressions.
    """
    row = lambda role: lambda e: F.struct(F.lit(role).alias("role"), e.alias("expression"))
    none = F.array().cast("array<string>")
    some = lambda c, role: F.transform(F.coalesce(c, none), row(role))
    parts = F.filter(F.concat(some(F.col("initialisers"), "initialiser"), some(F.array("expression"), "expression"), some(F.col("updaters"), "updater")), lambda p: p["expression"].isNotNull())
    return statements.select("method_fqn", "idx", F.posexplode(parts).alias("pos", "p")).select("method_fqn", "idx", "pos", "p.role", "p.expression")


def of_value(value: Column) -> Column:
    """How often a block runs that a condition guards: its value if it is constant, else perhaps."""
    return F.when(value, F.lit(ALWAYS)).when(~value, F.lit(NEVER)).otherwise(F.lit(CONDITIONALLY))


def block_executions(blocks: DataFrame) -> DataFrame:
    """With ``execution``: how often each block of a statement runs if the statement does.

    ``blocks``: method_fqn, idx, kind, block, role (body, then, else, main, catch, finally, entry or default) and value, which the
    statement's condition or the entry's label has if it is constant. A default entry runs if no other surely does.
    """
    value, role = F.col("value"), F.col("role")
    own = (
        F.when(F.col("kind").isin(*PLAIN) | role.isin("main", "finally"), F.lit(ALWAYS))
        .when(role == "catch", F.lit(CONDITIONALLY))
        .when(role == "else", of_value(~value))
        .when(role != "default", of_value(value))
    )
    from graphloom.plans.flow import default_branch

    keyed = blocks.withColumn("execution", own)
    filled = default_branch(keyed.where("role in ('entry', 'default')"), ["method_fqn", "idx"])
    rest = keyed.where("role not in ('entry', 'default')").select("method_fqn", "idx", "block", "execution")
    both = rest.unionByName(filled)
    return blocks.join(both, ["method_fqn", "idx", "block"]).select(*blocks.columns, "execution")


def fall_through(entries: DataFrame) -> DataFrame:
    """(method_fqn, idx, pos, labels): the labels that lead to each entry of an old-style switch: its own and those of entries before it that fall through.

    ``entries``: method_fqn, idx, pos, label (null for default), has_break.
    """
    order = Window.partitionBy("method_fqn", "idx").orderBy("pos")
    group = F.coalesce(F.sum(F.col("has_break").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = Window.partitionBy("method_fqn", "idx", "_g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_g", group).select("method_fqn", "idx", "pos", F.collect_list(F.coalesce("label", F.lit("default"))).over(upto).alias("labels"))


def entry_conditions(entries: DataFrame) -> DataFrame:
    """(method_fqn, idx, pos, condition) of the entries of a new-style switch; the default's negates all others.

    ``entries``: method_fqn, idx, pos, selector, labels (array, empty for default). A switch's entries are bounded by its text.
    """
    one = F.array_join(F.transform("labels", lambda label: F.concat(label, F.lit("=="), F.col("selector"))), "||")
    own = entries.withColumn("condition", F.when(F.size("labels") > 0, one))
    whole = Window.partitionBy("method_fqn", "idx")
    others = F.array_join(F.array_sort(F.collect_list("condition").over(whole)), "||")
    return own.select("method_fqn", "idx", "pos", F.coalesce("condition", F.when(others == "", F.lit("true")).otherwise(F.concat(F.lit("!("), others, F.lit(")")))).alias("condition"))


def yielded(entries: DataFrame) -> DataFrame:
    """(method_fqn, idx, value): a switch expression as a conditional over its entries' conditions and yielded values, in canonical form.

    ``entries``: method_fqn, idx, pos, condition (null for default), value.
    """
    from graphloom.functions.symbolic import canonical

    rows = entries.groupBy("method_fqn", "idx").agg(F.array_sort(F.collect_list(F.when(F.col("condition").isNotNull(), F.struct("pos", "condition", "value")))).alias("all"), F.max(F.when(F.col("condition").isNull(), F.col("value"))).alias("rest"))
    last = F.coalesce("rest", F.lit("null"))
    text = F.reduce(F.reverse("all"), last, lambda acc, e: F.concat(F.lit("("), e["condition"], F.lit(")?("), e["value"], F.lit("):("), acc, F.lit(")")))
    return rows.select("method_fqn", "idx", text.alias("value")).withColumn("value", canonical("value"))


def explicit_constructors(statements: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """(method_fqn, idx, ctor) of the constructors that ``this(...)`` and ``super(...)`` call, by their number of arguments; ties to the smaller name.

    ``statements``: method_fqn, idx, type_fqn, target ('this' or 'super'), n_args; ``methods``: method_fqn, type_fqn, is_ctor, n_params; ``types``: type_fqn, parent.
    """
    calls = statements.join(types.select("type_fqn", "parent"), "type_fqn", "left").select("method_fqn", "idx", F.when(F.col("target") == "super", F.col("parent")).otherwise(F.col("type_fqn")).alias("holder"), "n_args")
    ctors = methods.where("is_ctor").groupBy(F.col("type_fqn").alias("holder"), F.col("n_params").alias("n_args")).agg(F.min("method_fqn").alias("ctor"))
    return calls.join(ctors, ["holder", "n_args"]).select("method_fqn", "idx", "ctor")


def effects(statements: DataFrame) -> DataFrame:
    """With ``effect``: what an expression does as a statement: assign (also compound and stepping), create, call or none."""
    e = F.trim(F.coalesce("expression", F.lit("")))
    made = F.when(e.rlike(r"^[\w.$\[\]]+\s*([-+*/%&|^]|<<|>>>?)?=(?!=)|^(\+\+|--)|(\+\+|--)$"), F.lit("assign")).when(e.rlike(r"^new\b"), F.lit("create")).when(e.rlike(r"\)$"), F.lit("call"))
    return statements.withColumn("effect", F.coalesce(made, F.lit("none")))


def assignments(statements: DataFrame) -> DataFrame:
    """(method_fqn, idx, var_id, value): what statements assign, direct, compound and by steps; a return assigns ``return``. Values are canonical.

    ``statements``: method_fqn, idx, kind, expression.
    """
    from graphloom.functions.symbolic import canonical

    e = F.trim("expression")
    direct = F.regexp_extract(e, r"^([\w.$]+)\s*((?:[-+*/%&|^]|<<|>>>?)?)=(?!=)\s*(.*)$", 1)
    op, rhs = F.regexp_extract(e, r"^([\w.$]+)\s*((?:[-+*/%&|^]|<<|>>>?)?)=(?!=)\s*(.*)$", 2), F.regexp_extract(e, r"^([\w.$]+)\s*((?:[-+*/%&|^]|<<|>>>?)?)=(?!=)\s*(.*)$", 3)
    stepped = F.regexp_extract(e, r"^(?:\+\+|--)?\s*([\w.$]+?)\s*(?:\+\+|--)?$", 1)
    steps = e.rlike(r"^(\+\+|--)|(\+\+|--)$")
    var = F.when(F.col("kind") == "RETURN", F.lit("return")).when(direct != "", direct).when(steps, stepped)
    value = F.when(F.col("kind") == "RETURN", e).when(op != "", F.concat(direct, op, F.lit("("), rhs, F.lit(")"))).when(direct != "", rhs).when(e.contains("++"), F.concat(stepped, F.lit("+1"))).otherwise(F.concat(stepped, F.lit("-1")))
    return statements.select("method_fqn", "idx", var.alias("var_id"), value.alias("value")).where("var_id is not null").withColumn("value", canonical("value"))


def creations(locals_: DataFrame) -> DataFrame:
    """(method_fqn, idx, var_id, value): local variables as they are created; without initialiser they have no value yet, a loop's variable any.

    ``locals_``: method_fqn, idx, name, initialiser, in_loop.
    """
    value = F.coalesce("initialiser", F.when(F.col("in_loop"), F.concat(F.lit("<any:"), "name", F.lit(">"))), F.lit("<none>"))
    return locals_.select("method_fqn", "idx", F.concat("name", F.when(F.col("in_loop"), F.concat(F.lit("$"), "idx")).otherwise(F.lit(""))).alias("var_id"), value.alias("value"))


def statement_times(statements: DataFrame) -> DataFrame:
    """With ``time``: how often other threads may have written fields before a statement: after each synchronized block or modifying call.

    ``statements``: method_fqn, idx, kind, modifying_call.
    """
    before = Window.partitionBy("method_fqn").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    moves = ((F.col("kind") == "SYNCHRONIZED") | F.col("modifying_call")).cast("int")
    return statements.withColumn("time", F.coalesce(F.sum(moves).over(before), F.lit(0)))


def read_names(reads: DataFrame) -> DataFrame:
    """With ``name``: a variable as it is read: one that an enclosing loop assigns as ``x$loop``, a field that isn't final as ``x$time``.

    ``reads``: var_id, loop (null outside), is_field, is_final, time.
    """
    return reads.withColumn("name", F.when(F.col("loop").isNotNull(), F.concat("var_id", F.lit("$"), "loop")).when(F.col("is_field") & ~F.col("is_final"), F.concat("var_id", F.lit("$"), F.col("time").cast("string"))).otherwise(F.col("var_id")))


def local_types(statements: DataFrame, types: DataFrame) -> DataFrame:
    """(method_fqn, idx, type_fqn, primary_type) of the classes that statements declare, also anonymous ones in expressions.

    ``statements``: method_fqn, idx, declares (array of type_fqn); ``types``: type_fqn, primary_type of their methods' owners, by method_fqn.
    """
    own = statements.select("method_fqn", "idx", F.explode("declares").alias("type_fqn")).distinct()
    return own.join(types.select("method_fqn", "primary_type"), "method_fqn", "left").select("method_fqn", "idx", "type_fqn", "primary_type")


def evaluate_main(statements: DataFrame, state: DataFrame) -> DataFrame:
    """With ``value``: each statement's expression under the values that its variables have there, in canonical form.

    ``statements``: method_fqn, idx, expression; ``state``: method_fqn, idx, var_id, value; values without an expression, such
    as ``<unknown>``, aren't put in. A statement's variables are few.
    """
    from graphloom.functions.symbolic import substituted

    names = state.where("value not like '<%'").groupBy("method_fqn", "idx").agg(F.array_sort(F.collect_set(F.struct(F.col("var_id").alias("old"), F.col("value").alias("new")))).alias("_names"))
    none = F.array().cast("array<struct<old:string,new:string>>")
    joined = statements.join(names, ["method_fqn", "idx"], "left").withColumn("_names", F.coalesce("_names", none))
    return joined.withColumn("value", F.coalesce(substituted("expression", "_names"), F.col("expression"))).drop("_names")


def apply_evaluation(state: DataFrame, results: DataFrame) -> DataFrame:
    """(method_fqn, var_id, value, assign_ids): variables after a statement: what it assigned, else what they were; assignments are added to their ids.

    ``state``: method_fqn, var_id, value, assign_ids (array); ``results``: method_fqn, var_id, idx, value.
    """
    joined = state.join(results.select("method_fqn", "var_id", F.col("idx").alias("_i"), F.col("value").alias("_v")), ["method_fqn", "var_id"], "full")
    ids = F.coalesce("assign_ids", F.array().cast("array<string>"))
    return joined.select("method_fqn", "var_id", F.coalesce("_v", "value").alias("value"), F.when(F.col("_i").isNotNull(), F.array_sort(F.array_union(ids, F.array("_i")))).otherwise(ids).alias("assign_ids"))


def from_closures(results: DataFrame, closures: DataFrame, own_locals: DataFrame) -> DataFrame:
    """Results of a method and of the lambdas and local classes in it, but for variables that are local to these.

    ``results``: method_fqn, var_id, v; ``closures``: method_fqn (of the closure), outer; ``own_locals``: method_fqn, var_id.
    """
    moved = results.join(own_locals.select("method_fqn", "var_id"), ["method_fqn", "var_id"], "left_anti").join(closures, "method_fqn").select(F.col("outer").alias("method_fqn"), "var_id", "v")
    inner = results.join(closures.select("method_fqn"), "method_fqn", "left_anti")
    return inner.select("method_fqn", "var_id", "v").unionByName(moved).groupBy("method_fqn", "var_id").agg(F.max("v").alias("v"))


def state_after_try(blocks: DataFrame) -> DataFrame:
    """(method_fqn, idx, state): if the main block escapes, some catch that doesn't has run; else no catch that escapes has.

    ``blocks``: method_fqn, idx, role ('main' or 'catch'), condition (of a catch), escapes.
    """
    kept = lambda escapes: F.array_sort(F.collect_set(F.when((F.col("role") == "catch") & (F.col("escapes") == escapes), F.col("condition"))))
    g = blocks.groupBy("method_fqn", "idx").agg(F.bool_or((F.col("role") == "main") & F.col("escapes")).alias("main"), kept(False).alias("back"), kept(True).alias("gone"))
    either = F.when(F.size("back") == 0, F.lit("false")).otherwise(F.array_join("back", "||"))
    none = F.when(F.size("gone") == 0, F.lit("true")).otherwise(F.array_join(F.transform("gone", lambda c: F.concat(F.lit("!"), c)), "&&"))
    return g.select("method_fqn", "idx", F.when(F.col("main"), either).otherwise(none).alias("state"))


def state_after_assert(statements: DataFrame) -> DataFrame:
    """With ``after``: what is known after an assertion, in canonical form. ``statements``: state, condition."""
    from graphloom.functions.symbolic import canonical

    both = F.concat(F.lit("("), F.coalesce("state", F.lit("true")), F.lit(")&&("), "condition", F.lit(")"))
    return statements.withColumn("after", both).withColumn("after", canonical("after"))


# a whole method -----------------------------------------------------------------------------------------------

WALKED = "method_fqn string, idx string, reached int, state string, value string"


def _walk(rows: list[dict]) -> list[tuple]:
    """(idx, reached, state, value) of a method's statements, and of its return value under idx ``return``.

    Values are symbolic. Branches meet in conditionals; a variable that a loop assigns is unknown in it and after it, and named
    after the loop. A statement after one that surely ends the block is never reached.
    """
    from graphloom.functions.symbolic import FALSE, TRUE, and_, cond, decide, negate, parse, show, substitute, var

    children: dict[str, list[dict]] = {}
    for r in rows:
        children.setdefault(r["idx"].rpartition(".")[0], []).append(r)
    for c in children.values():
        c.sort(key=lambda r: int(r["idx"].rpartition(".")[2]))
    out: list[tuple] = []
    returned: list[tuple] = []

    def assigned(prefix: str) -> set[str]:
        return {r["target"] for r in rows if r["idx"].startswith(prefix) and r["target"]}

    def known(state, c):
        told = decide(show(state), show(c))
        return told

    def block(at: str, env: dict, state, reached: int):
        for r in children.get(at, []):
            kind, idx = r["kind"], r["idx"]
            value = substitute(parse(r["expression"]), env) if r["expression"] else None
            out.append((idx, reached, show(state), show(value) if value is not None else None))
            if kind == "RETURN":
                if reached:
                    returned.append((state, value))
                reached = NEVER
            elif kind in ("THROW", "BREAK", "CONTINUE"):
                reached = NEVER
            elif kind == "ASSERT":
                state = and_(state, value)
            elif kind == "IF_ELSE":
                told = known(state, value)
                runs = lambda yes: reached if told is yes else NEVER if told is not None else min(reached, CONDITIONALLY)
                env1, state1, reached1 = block(f"{idx}.0", dict(env), and_(state, value), runs(True))
                env2, state2, reached2 = block(f"{idx}.1", dict(env), and_(state, negate(value)), runs(False))
                if not reached1 or not reached2:
                    if reached1 or reached2:
                        env, state = (env1, state1) if reached1 else (env2, state2)
                    reached = max(reached1, reached2)
                else:
                    env = {x: cond(value, env1.get(x, var(x)), env2.get(x, var(x))) for x in {*env1, *env2}}
            elif kind in ("WHILE", "FOR", "FOREACH", "DO"):
                env = env | {x: var(f"{x}${idx}") for x in assigned(f"{idx}.")}
                test = substitute(parse(r["expression"]), env) if r["expression"] else TRUE
                first = known(state, value) if kind != "DO" and value is not None else True if kind == "DO" else None
                inside = reached if first else NEVER if first is False else min(reached, CONDITIONALLY)
                block(f"{idx}.0", dict(env), state if kind == "DO" else and_(state, test), inside)
                if kind != "FOREACH" and r["expression"] and not any(x["kind"] == "BREAK" and x["idx"].startswith(f"{idx}.") for x in rows):
                    state = and_(state, negate(test))
                    reached = NEVER if state == FALSE else reached
            elif kind in ("BLOCK", "SYNCHRONIZED"):
                env, state, reached = block(f"{idx}.0", env, state, reached)
            elif r["target"]:
                env = env | {r["target"]: value}
        return env, state, reached

    end, state, reached = block("", {}, TRUE, ALWAYS)
    if returned:
        *first, (_, last) = returned
        for c, v in reversed(first):
            last = cond(c, v, last) if v is not None and last is not None else None
        out.append(("return", reached, show(state), show(last) if last is not None else None))
    return out + [(f"end:{x}", reached, show(state), show(v)) for x, v in sorted(end.items())]


def analyse_statements(statements: DataFrame) -> DataFrame:
    """RM1, W1, W4 to W8, W16: (method_fqn, idx, reached, state, value): every statement of every method, walked through in order.

    ``statements``: method_fqn, idx, kind, target, expression. Besides the statements there is a row ``return`` with the value
    that a method returns, and ``end:x`` with the value of each variable at its end. A method, which somebody wrote, is one
    group; a method that can't be read gives a row ``error``. Rows with a null method_fqn or idx take no part.
    """

    def run(pdf):
        import pandas as pd

        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        try:
            found = _walk(rows)
        except (ValueError, RecursionError, TypeError) as e:
            found = [("error", NEVER, None, str(e)[:200])]
        return pd.DataFrame([(rows[0]["method_fqn"], *x) for x in found], columns=["method_fqn", "idx", "reached", "state", "value"])

    own = statements.where("method_fqn is not null and idx is not null").select("method_fqn", "idx", "kind", "target", "expression")
    return own.groupBy("method_fqn").applyInPandas(run, WALKED)
