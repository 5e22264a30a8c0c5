"""Projections and predicates over the entities of a program graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import closure, supertypes
from graphloom.staging import written


def contained_sets(members: DataFrame, key: str, member: str) -> DataFrame:
    """RT6, relational division: (key, g): pairs of keys, the members of the first being members of the second.

    Whoever holds all members of a key holds its rarest one, so that one's holders are compared alone; members in common are
    counted, and the first is contained if it has no more than these.
    """
    m = members.select(F.col(key).alias("f"), F.col(member).alias("m")).where("f is not null and m is not null").distinct()
    held = m.groupBy("m").agg(F.count(F.lit(1)).alias("held"))
    rarest = m.join(held, "m").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("held", "m")).alias("rarest")).select("f", "n", F.col("rarest.m").alias("m"))
    other = m.select(F.col("f").alias("g"), "m")
    could = rarest.join(other, "m").where("f <> g").select("f", "n", "g")
    common = could.join(m, "f").join(other, ["g", "m"]).groupBy("f", "g", "n").agg(F.count(F.lit(1)).alias("c"))
    return common.where("c = n").select(F.col("f").alias(key), "g")


def direct_supers(types: DataFrame) -> DataFrame:
    """F8: (src, dst) from a type to its parent and its interfaces."""
    return types.select(F.col("type_fqn").alias("src"), F.explode(F.array_compact(F.concat(F.array("parent"), F.coalesce("interfaces", F.array().cast("array<string>"))))).alias("dst")).distinct()


ROOT = "java.lang.Object"


def supers(types: DataFrame, root: str = ROOT) -> DataFrame:
    """(type, super, distance), the root left out."""
    return supertypes(direct_supers(types).where(F.col("dst") != root))


def enclosing_closure(types: DataFrame) -> DataFrame:
    """(start, node): each type and all that enclose it."""
    return closure(types.where("enclosing is not null").select(F.col("type_fqn").alias("src"), F.col("enclosing").alias("dst")), types.select("type_fqn"))


def methods_of(types: DataFrame, methods: DataFrame, mode: str = "THIS_TYPE_ONLY") -> DataFrame:
    """(type, method_fqn) in one of five modes.

    The EXCLUDE modes leave out methods with a field SAM (column ``of_field_sam``: null, 'real' or 'artificial').
    """
    own = methods.select(F.col("type_fqn").alias("holder"), "method_fqn", *(["of_field_sam"] if "of_field_sam" in methods.columns else [F.lit(None).cast("string").alias("of_field_sam")]))
    if mode.startswith("THIS_TYPE_ONLY"):
        keep = {"THIS_TYPE_ONLY": F.lit(True), "THIS_TYPE_ONLY_EXCLUDE_FIELD_SAM": F.col("of_field_sam").isNull(), "THIS_TYPE_ONLY_EXCLUDE_FIELD_ARTIFICIAL_SAM": F.coalesce(F.col("of_field_sam") != "artificial", F.lit(True))}[mode]
        return own.where(keep).select(F.col("holder").alias("type"), "method_fqn")
    if mode == "INCLUDE_SUBTYPES":
        near = enclosing_closure(types).select(F.col("node").alias("type"), F.col("start").alias("holder"))
    elif mode == "INCLUDE_SUPERTYPES":
        near = supers(types).select("type", F.col("super").alias("holder")).union(types.select("type_fqn", "type_fqn"))
    else:
        raise ValueError(f"no such mode: {mode}")
    return near.join(own, "holder").select("type", "method_fqn").distinct()


def methods_in_initialisers(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(field_fqn, method_fqn) of methods of the type that a field's initialiser creates (column initialiser)."""
    return fields.where("initialiser is not null").join(methods.select("method_fqn", F.col("type_fqn").alias("t")), F.col("initialiser") == F.col("t")).select("field_fqn", "method_fqn")


def static_blocks(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, method_fqn) of the static blocks of a type and of all that it encloses."""
    return methods_of(types, methods.where("is_static and name like '$static%'"), "INCLUDE_SUBTYPES")


def types_referenced(refs: DataFrame) -> DataFrame:
    """(src_type, target_type, explicit); one explicit reference outweighs implicit ones. ``refs``: src_type, targets (array of (type, explicit))."""
    each = refs.select("src_type", F.explode("targets").alias("t"))
    return each.groupBy("src_type", F.col("t.type").alias("target_type")).agg(F.bool_or("t.explicit").alias("explicit"))


def accessible(access: Column, same_package: Column, same_primary: Column, below: Column) -> Column:
    """Whether a member can be seen: public, protected below or in the package, package, private in the primary type."""
    return F.when(same_primary, F.lit(True)).when(access == "PUBLIC", F.lit(True)).when(access == "PROTECTED", same_package | below).when(access == "PACKAGE", same_package).otherwise(F.lit(False))


def meet(many: DataFrame, few: DataFrame, on: list[str], slice_: int = 20_000, where: Column | None = None) -> DataFrame:
    """The join of both, for joins that make many more rows than they read: a key's rows of ``many`` are dealt into slices, and
    each slice meets a copy of the key's rows of ``few``, so that no task makes all rows of a frequent key. ``where``: which rows stay."""
    slices = written(many.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("_slices")).join(few.select(*on).distinct(), on, "left_semi"), "slices")
    dealt = many.join(slices, on).withColumn("_slice", F.pmod(F.xxhash64(*many.columns), F.col("_slices")).cast("int")).drop("_slices")
    copies = few.join(slices, on).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    met = dealt.join(copies, [*on, "_slice"])
    return (met if where is None else met.where(where)).drop("_slice")


def _seen(types: DataFrame, holders: DataFrame) -> DataFrame:
    """(type, holder, p1, t1, p2, t2, below): a type and those of ``holders`` that are itself, its super types or enclose it, with both packages and primary types."""
    home, starts = types.select("type_fqn", "package", "primary_type"), holders.select("holder").distinct()
    turned = lambda edges, src, dst: edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"))
    below = closure(turned(direct_supers(types).where(F.col("dst") != ROOT), "src", "dst"), starts, include_start=False)
    inside = closure(turned(types.where("enclosing is not null"), "type_fqn", "enclosing"), starts)
    reach = below.select("node", "start", F.lit(True).alias("below")).union(inside.select("node", "start", F.lit(False))).toDF("type", "holder", "below")
    reach = reach.groupBy("type", "holder").agg(F.bool_or("below").alias("below"))
    return reach.join(home.select(F.col("type_fqn").alias("type"), F.col("package").alias("p1"), F.col("primary_type").alias("t1")), "type").join(home.select(F.col("type_fqn").alias("holder"), F.col("package").alias("p2"), F.col("primary_type").alias("t2")), "holder")


def _visible(seen: DataFrame, members: DataFrame, *shown: str) -> DataFrame:
    """(type, *shown) of the members that a type sees, once each. ``members``: holder, access and the columns shown.

    Types, holders and accesses are few beside the rows that come of them. They are decided on first, so that a pair is made
    once; only of members that are shown alike in several places can pairs repeat, and only these are made distinct.
    """
    members = members.select("holder", "access", *shown).distinct()
    places = members.groupBy(*(F.col(c).alias(f"_{c}") for c in shown)).agg(F.count(F.lit(1)).alias("_n"))
    members = members.join(places, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shown]).select("holder", "access", *shown, "_n")
    kinds = members.select("holder", "access").distinct()
    decided = seen.join(kinds, "holder").where(accessible(F.col("access"), F.col("p1") == F.col("p2"), F.col("t1") == F.col("t2"), F.col("below")))
    # types that are given more than once are decided on more than once
    pairs = written(decided.select("type", "holder", F.coalesce("access", F.lit("")).alias("access")).distinct(), "visible")
    members = written(members.withColumn("access", F.coalesce("access", F.lit(""))).distinct(), "members")
    made = lambda part: meet(pairs, members.where(part), ["holder", "access"]).select("type", *shown)
    return made("_n = 1").union(made("_n > 1").distinct())


def accessible_fields(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(type, field_fqn) of the fields that a type sees in itself, its super types and those that enclose it."""
    members = fields.select(F.col("type_fqn").alias("holder"), "field_fqn", "access")
    return _visible(_seen(types, members), members, "field_fqn")


def accessible_types(types: DataFrame) -> DataFrame:
    """(type, simple_name, type_fqn) of the nested types that a type sees by simple name: those of itself, its super types and those that enclose it."""
    nested = types.where("enclosing is not null").select(F.col("enclosing").alias("holder"), "simple_name", "type_fqn", "access")
    return _visible(_seen(types, nested), nested, "simple_name", "type_fqn")


def overrides(types: DataFrame, methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """(method_fqn, overridden, distance): methods of super types of the same name, arity and erased parameter types."""
    args = parameters.groupBy("method_fqn").agg(F.array_join(F.array_sort(F.collect_list(F.struct("index", "ptype"))).getField("ptype"), ",").alias("args"))
    sig = methods.where("not is_ctor and not is_static and access <> 'PRIVATE'").join(args, "method_fqn", "left").select("method_fqn", "type_fqn", "name", F.coalesce("args", F.lit("")).alias("args"))
    up = supers(types)
    mine, theirs = sig.withColumnRenamed("type_fqn", "type"), sig.select(F.col("method_fqn").alias("overridden"), F.col("type_fqn").alias("super"), "name", "args")
    return mine.join(up, "type").join(theirs, ["super", "name", "args"]).select("method_fqn", "overridden", "distance")


def functional_interfaces(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(type): interfaces with one abstract method, over their super types; methods of one signature count once."""
    reach = methods_of(types, methods.where("is_abstract and not is_static and not is_default"), "INCLUDE_SUPERTYPES")
    named = reach.join(methods.select("method_fqn", "name", "n_params"), "method_fqn")
    one = named.groupBy("type").agg(F.countDistinct("name", "n_params").alias("n")).where("n = 1")
    return one.join(types.where("nature = 'INTERFACE'").select(F.col("type_fqn").alias("type")), "type", "left_semi").select("type")


#: A primitive and its box, and primitives by width.
BOXES = {"int": "java.lang.Integer", "long": "java.lang.Long", "short": "java.lang.Short", "byte": "java.lang.Byte", "char": "java.lang.Character", "boolean": "java.lang.Boolean", "float": "java.lang.Float", "double": "java.lang.Double"}
WIDTHS = {"byte": 0, "short": 1, "char": 1, "int": 2, "long": 3, "float": 4, "double": 5}


def assignable(pairs: DataFrame, hierarchy: DataFrame, boxing: int = 1) -> DataFrame:
    """``pairs`` (target, source) with distance, null where the source can't be assigned: same 0, wider primitive, box, super type."""
    spark = pairs.sparkSession
    wide = [(a, b, WIDTHS[a] - WIDTHS[b]) for a in WIDTHS for b in WIDTHS if WIDTHS[a] > WIDTHS[b] and a != "char"]
    box = [(b, p, boxing) for p, b in BOXES.items()] + [(p, b, boxing) for p, b in BOXES.items()]
    fixed = spark.createDataFrame(wide + box, "target string, source string, fixed int")
    up = hierarchy.select(F.col("super").alias("target"), F.col("type").alias("source"), F.col("distance").alias("up"))
    found = pairs.join(F.broadcast(fixed), ["target", "source"], "left").join(up, ["target", "source"], "left")
    root = F.when((F.col("target") == "java.lang.Object") & ~F.col("source").isin(list(BOXES)), F.lit(100))
    return found.select("target", "source", F.when(F.col("target") == F.col("source"), F.lit(0)).otherwise(F.coalesce("fixed", "up", root)).alias("distance"))


def best_overload(candidates: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(call_id, method_fqn): of each call's candidates that take all arguments the one at the least total distance, ties by name.

    ``candidates``: call_id, method_fqn, index, formal, actual, a row per argument; a null formal is an argument too many.
    """
    d = assignable(candidates.select(F.col("formal").alias("target"), F.col("actual").alias("source")).distinct(), hierarchy).select(F.col("target").alias("formal"), F.col("source").alias("actual"), "distance")
    rated = candidates.join(d, ["formal", "actual"], "left")
    fit = rated.groupBy("call_id", "method_fqn").agg(F.bool_and(F.col("distance").isNotNull()).alias("fits"), F.sum("distance").alias("total")).where("fits")
    return fit.groupBy("call_id").agg(F.min(F.struct("total", "method_fqn")).alias("b")).select("call_id", "b.method_fqn")


def not_read_after_assignment(read_id: Column, assign_ids: Column, index: Column) -> Column:
    """whether nothing was read since the latest assignment before a statement; ids are compared as strings."""
    latest = F.array_max(F.filter(assign_ids, lambda a: a < index))
    return latest.isNotNull() & (F.coalesce(read_id, F.lit("")) < latest)


def own_clauses(clauses: DataFrame, variables: DataFrame, accept: bool = True) -> DataFrame:
    """per expression the clauses about one of the variables alone, or, rejecting, the rest: (expr_id, clauses).

    ``clauses``: expr_id, clause, vars (array); ``variables``: expr_id, var.
    """
    wanted = variables.groupBy("expr_id").agg(F.collect_set("var").alias("wanted"))
    joined = clauses.join(wanted, "expr_id", "left").withColumn("mine", F.coalesce((F.size(F.array_except("vars", "wanted")) == 0) & (F.size("vars") > 0), F.lit(False)))
    return joined.where(F.col("mine") == accept).groupBy("expr_id").agg(F.array_sort(F.collect_set("clause")).alias("clauses"))


def subtree(exprs: DataFrame, roots: DataFrame, stop_at: Column | None = None) -> DataFrame:
    """F16: (root, expr_id) of all nodes below roots; below nodes where ``stop_at`` holds the walk ends. ``exprs``: expr_id, parent_id and what the predicate needs."""
    edges = exprs.select(F.col("parent_id").alias("src"), F.col("expr_id").alias("dst")).where("src is not null")
    if stop_at is not None:
        edges = edges.join(exprs.where(stop_at).select(F.col("expr_id").alias("src")), "src", "left_anti")
    return closure(edges, roots.select(roots.columns[0])).select(F.col("start").alias("root"), F.col("node").alias("expr_id"))


def usage(refs: DataFrame, packages: list[str]) -> DataFrame:
    """The elements used, in packages that are accepted: (kind, target_fqn)."""
    from graphloom.sources.filters import accepts

    own = refs.where(accepts(F.col("target_package"), packages))
    types = own.select(F.lit("type").alias("kind"), F.col("target_type").alias("target_fqn"))
    return own.where("kind <> 'type'").select("kind", "target_fqn").union(types).distinct()


def hidden_content(field_types: DataFrame, explicit: DataFrame) -> DataFrame:
    """G23, RT2: (owner, type) of fields' and parameters' types that the owner never uses explicitly."""
    return field_types.select("owner", "type").distinct().join(explicit.select("owner", "type"), ["owner", "type"], "left_anti")


def companions(methods: DataFrame) -> DataFrame:
    """(method_fqn, type_fqn, base, action, aspect) of companion methods ``base$Action$Aspect``."""
    part = lambda k: F.nullif(F.regexp_extract("name", r"^(\w+)\$([A-Z]\w*)(?:\$(\w+))?$", k), F.lit(""))
    return methods.select("method_fqn", "type_fqn", part(1).alias("base"), part(2).alias("action"), part(3).alias("aspect")).where("action is not null")


def arguments_to_parameters(args: DataFrame, methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each argument with its formal parameter; beyond the last one of a varargs method that last one. ``args``: call_id, method_fqn, pos."""
    n = methods.select("method_fqn", "n_params", F.coalesce("is_varargs", F.lit(False)).alias("va"))
    at = F.when(F.col("va"), F.least(F.col("pos"), F.col("n_params") - 1)).otherwise(F.col("pos"))
    return args.join(n, "method_fqn").withColumn("index", at).join(parameters.select("method_fqn", "index", F.col("name").alias("parameter"), "ptype"), ["method_fqn", "index"]).drop("n_params", "va")


def lookup(elements: DataFrame, own: DataFrame, parent: DataFrame, default: int = -1) -> DataFrame:
    """Each element's value: its own context's, else the parent context's, else a default (a delay)."""
    a, b = own.select("elem", F.col("v").alias("_a")), parent.select("elem", F.col("v").alias("_b"))
    return elements.join(a, "elem", "left").join(b, "elem", "left").select(*elements.columns, F.coalesce("_a", "_b", F.lit(default)).alias("v"))


def union_types(a: Column, b: Column) -> Column:
    """The union of two sets of types."""
    return F.array_sort(F.array_union(a, b))


def common_types(a: Column, b: Column) -> Column:
    """The types in both sets; ``*`` stands for all types."""
    return F.when(F.array_contains(a, "*"), b).when(F.array_contains(b, "*"), a).otherwise(F.array_sort(F.array_intersect(a, b)))


def positions(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``position``, from 0, in the order of ``by``: sorted by ranges, and counted on from the sizes of
    the ranges before, a number for each partition."""
    from graphloom.staging import written

    sorted_ = written(rows.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "order")
    sizes = sorted(sorted_.groupBy("_part").count().collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    base = sorted_.sparkSession.createDataFrame(starts, "_part int, _base long")
    return sorted_.join(F.broadcast(base), "_part").withColumn("position", F.col("_base") + F.col("_n")).drop("_part", "_n", "_base")


def analysis_order(layered: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Elements by layer and name, or by name alone. ``layered``: node, layer."""
    return layered.orderBy("node") if alphabetical else layered.orderBy("layer", "node")
