"""Graph operators over edge tables (src, dst), src depending on dst. Every loop is a few joins a round and ends by itself.

Rounds write their result in the shared folder, so plans stay short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.staging import written, written_with


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def closure(edges: DataFrame, starts: DataFrame | None = None, include_start: bool = True) -> DataFrame:
    """(start, node) of all that a start depends on, over any number of steps.

    ``include_start``: a start is in its own closure; else only if it is on a cycle. From given starts a round is a
    step, and only what the last round found is joined again; without ``starts`` all nodes are starts, and rounds
    double the steps.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    if starts is None:
        pairs = closure_by_squaring(edges)
        return pairs.union(_nodes(edges).select("node", "node")).distinct() if include_start else pairs
    seeds = starts.select(F.col(starts.columns[0]).alias("start")).where("start is not null").distinct()
    if include_start:
        first = seeds.select("start", F.col("start").alias("node"))
    else:
        first = seeds.join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
    fresh, told = written_with(first, "closure", _rows())
    known = fresh
    while told["n"]:
        found = fresh.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh, told = written_with(found.join(known, ["start", "node"], "left_anti"), "closure", _rows())
        known = known.unionByName(fresh)
    return known


def closure_by_squaring(edges: DataFrame) -> DataFrame:
    """G2 for all nodes in about log(depth) rounds: what the last round found is joined with all that is known, from both sides.

    For deep graphs of few pairs: the result has a row for every pair.
    """
    fresh, told = written_with(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure", _rows())
    known = fresh
    while told["n"]:
        then = lambda x, y: x.alias("a").join(y.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        found = then(known, fresh).union(then(fresh, known)).distinct()
        fresh, told = written_with(found.join(known, ["src", "dst"], "left_anti"), "closure", _rows())
        known = known.unionByName(fresh)
    return known.select(F.col("src").alias("start"), F.col("dst").alias("node"))


def supertypes(direct: DataFrame) -> DataFrame:
    """(type, super, distance): all super types at their least distance. ``direct``: (src, dst)."""
    known = fresh = written(direct.select("src", "dst").distinct().withColumn("distance", F.lit(1)), "supers")
    depth = 1
    while True:
        depth += 1
        found = fresh.select("src", F.col("dst").alias("mid")).join(direct.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh, told = written_with(found.join(known, ["src", "dst"], "left_anti").withColumn("distance", F.lit(depth)), "supers", _rows())
        if not told["n"]:
            break
        known = known.unionByName(fresh)
    return known.select(F.col("src").alias("type"), F.col("dst").alias("super"), "distance")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).where("node is not null").distinct()


def _blocked(nodes: DataFrame, edges: DataFrame, by: str, on: str) -> DataFrame:
    """The nodes that still have an edge to another of ``nodes``."""
    return nodes.join(edges.select(F.col(by).alias("node"), F.col(on).alias("other")).join(nodes.select(F.col("node").alias("other")), "other", "left_semi"), "node", "left_semi")


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, layer, how) in topological order; ``how`` is free, trimmed or cut.

    A round takes the nodes all of whose dependencies are done: it counts, for the nodes that depend on what the last
    round took, how many of their dependencies are done by now, and touches no other nodes. Where none is free, nodes
    that lie on no cycle are trimmed from both sides, and then one node is cut out of a cycle: of those that the
    smallest node left depends on, the one with the fewest dependencies among them, ties to the smaller. Edges to
    oneself don't count. ``edges`` may have a null dst for a node without dependencies.
    """
    all_nodes = _nodes(edges) if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node")).union(_nodes(edges)).distinct()
    links = written(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "links")
    all_nodes, told = written_with(all_nodes, "nodes", _rows())
    needs = written(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("needs")), "needs")
    total, layer = told["n"], 0
    free, told = written_with(all_nodes.join(needs, "node", "left_anti").select("node", F.lit(0).alias("layer"), F.lit("free").alias("how")), "layer", _rows())
    done, n_done = free, told["n"]
    partly = needs.limit(0).select("node", F.lit(0).cast("long").alias("have"))
    while n_done < total:
        if told["n"]:
            met = links.join(free.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("have"))
            sums = partly.union(met.select("node", "have")).groupBy("node").agg(F.sum("have").alias("have")).join(needs, "node")
            # a node that was cut or trimmed is done, however many of its dependencies are
            left = sums.join(done.where("how <> 'free'").select("node"), "node", "left_anti")
            split, told = written_with(left.select("node", "have", (F.col("have") == F.col("needs")).alias("free")), "met", F.coalesce(F.count_if("free"), F.lit(0)).alias("n"))
            partly, layer = split.where("not free").select("node", "have"), layer + 1
            if told["n"]:
                free = split.where("free").select("node", F.lit(layer).alias("layer"), F.lit("free").alias("how"))
                done, n_done = done.unionByName(free), n_done + told["n"]
                continue
        core, told = written_with(all_nodes.join(done.select("node"), "node", "left_anti"), "left", _rows())
        left, kept = core, None
        while told["n"] != kept:
            kept = told["n"]
            core, told = written_with(_blocked(_blocked(core, links, "src", "dst"), links, "dst", "src"), "core", _rows())
        trimmed = left.join(core, "node", "left_anti").select("node", F.lit(layer).alias("layer"), F.lit("trimmed").alias("how"))
        inside = links.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi")
        part = closure(inside, core.agg(F.min("node").alias("node")))
        degree = part.join(inside, F.col("node") == F.col("src")).join(part.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("node").agg(F.countDistinct("dst").alias("k"))
        cut = degree.orderBy("k", "node").limit(1).select("node", F.lit(layer + 1).alias("layer"), F.lit("cut").alias("how"))
        free, told = written_with(trimmed.union(cut), "layer", _rows())
        done, n_done, layer = done.unionByName(free), n_done + told["n"], layer + 1
    return done


#: Up to so many edges all pairs are few, and cycles are read from them.
FEW = 2_000


def _core(links: DataFrame) -> tuple[DataFrame, int]:
    """The edges that can lie on a cycle: others are taken away from both ends until no more go."""
    links, told = written_with(links, "core", _rows())
    n = None
    while told["n"] and told["n"] != n:
        n = told["n"]
        going, coming = links.select(F.col("src").alias("dst")).distinct(), links.select(F.col("dst").alias("src")).distinct()
        links, told = written_with(links.join(coming, "src", "left_semi").join(going, "dst", "left_semi"), "core", _rows())
    return links, told["n"]


def _least_before(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which each node is reached, itself included. Only labels that fell go on."""
    best = fresh = written(_nodes(links).select("node", F.col("node").alias("label")), "labels")
    n = 1
    while n:
        found = fresh.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        old = best.select("node", F.col("label").alias("old"))
        merged, told = written_with(old.join(found, "node", "left").select("node", F.least("old", "label").alias("label"), F.coalesce(F.col("label") < F.col("old"), F.lit(False)).alias("fell")), "labels", F.coalesce(F.count_if("fell"), F.lit(0)).alias("n"))
        best, fresh, n = merged.drop("fell"), merged.where("fell").drop("fell"), told["n"]
    return best


def cycle_groups(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, cycle): nodes that depend on one another have the same cycle, its smallest node; others their own.

    Edges that no cycle can hold are taken away. Then every node gets the smallest node before it, and the nodes that lead
    back to that one by nodes of the same label are its cycle; what is left goes through this once more. A round has a row for each
    edge at most. Graphs of up to ``few`` edges are read from their closure, which takes fewer rounds.
    """
    links = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    links, told = written_with(links, "links", _rows())
    if told["n"] <= few:
        reach = closure_by_squaring(links)
        both = reach.alias("a").join(reach.alias("b"), (F.col("a.start") == F.col("b.node")) & (F.col("a.node") == F.col("b.start")))
        found = both.select(F.col("a.start").alias("node"), F.col("a.node").alias("other")).groupBy("node").agg(F.min("other").alias("cycle"))
    else:
        found = links.limit(0).select(F.col("src").alias("node"), F.col("src").alias("cycle"))
        links, n = _core(links)
        while n:
            label = _least_before(links)
            side = lambda key: label.select(F.col("node").alias(key), F.col("label").alias(f"{key}_label"))
            same = written(links.join(side("src"), "src").join(side("dst"), "dst").where("src_label = dst_label").select("src", "dst"), "same")
            back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            group = written(reaches(back, label.where("node = label").select("node")).join(label, "node").select("node", F.col("label").alias("cycle")), "group")
            found = found.union(group)
            gone = group.select("node")
            links, n = _core(links.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return _nodes(edges).join(found, "node", "left").select("node", F.coalesce("cycle", "node").alias("cycle"))


def reaches(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts and all that is reached from any of them; each node is taken on once."""
    fresh, told = written_with(starts.select(F.col(starts.columns[0]).alias("node")).distinct(), "reached", _rows())
    known = fresh
    while told["n"]:
        found = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh, told = written_with(found.join(known, "node", "left_anti"), "reached", _rows())
        known = known.unionByName(fresh)
    return known


def induced(edges: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """The edges among ``nodes``, turned around if asked."""
    own = nodes.select(F.col(nodes.columns[0]).alias("n"))
    inside = edges.join(own, F.col("src") == F.col("n"), "left_semi").join(own, F.col("dst") == F.col("n"), "left_semi")
    return inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else inside.select("src", "dst")


def add_node(edges: DataFrame, more: DataFrame, bidirectional: bool = False) -> DataFrame:
    """More edges, and their mirror images if asked."""
    new = more.select("src", "dst")
    new = new.union(new.select("dst", "src")) if bidirectional else new
    return edges.select("src", "dst").union(new).distinct()


def size_and_relations(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_relations)."""
    return _nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.where("dst is not null").distinct().agg(F.count(F.lit(1)).alias("n_relations")))


def rank_of(w: Column) -> Column:
    """A weight's place in 0 < delayed < 1 < 2 ..., doubled so that the delay fits in between."""
    return F.when(w == -1, F.lit(1)).otherwise(w * 2)


def weight_of(rank: Column) -> Column:
    return F.when(rank == 1, F.lit(-1)).otherwise((rank / 2).cast("int"))


def add_weighted(edges: DataFrame, mirror: bool = False) -> DataFrame:
    """Parallel edges (src, dst, w) merged to the least rank, and mirrored if asked."""
    both = edges.select("src", "dst", "w")
    both = both.union(both.select("dst", "src", "w")) if mirror else both
    return both.groupBy("src", "dst").agg(weight_of(F.min(rank_of(F.col("w")))).alias("w"))


#: Of mirrored links with up to so many different weights, each weight's components are worked out. Starts up to this number are broadcast.
LEVELS, STARTS = 16, 10_000


def _by_levels(usable: DataFrame, seeds: DataFrame, weights: list[int]) -> DataFrame:
    """(start, node, w) over mirrored edges: w is the least weight whose edges, with all lighter ones, connect both.

    A weight's components join those of the lighter ones, so each edge and each node goes through once a weight, however many
    starts there are, and the result is made by one join.
    """
    level = written(_nodes(usable).union(seeds.select("start")).where("node is not null").distinct().withColumn("last", F.col("node")), "level")
    names = []
    for n, w in enumerate(weights):
        label = lambda key: level.select(F.col("node").alias(key), F.col("last").alias(f"{key}_last"))
        joined = usable.where((F.col("w") == w) & (F.col("src") < F.col("dst"))).join(label("src"), "src").join(label("dst"), "dst")
        found = connected_components(joined, "src_last", "dst_last").withColumnRenamed("node", "last")
        level = written(level.join(found, "last", "left").select("node", *names, F.coalesce("component", "last").alias(f"l{n}"), F.coalesce("component", "last").alias("last")), "level")
        names.append(f"l{n}")
    seeds, told = written_with(seeds.where("start is not null").withColumnRenamed("start", "node").join(level, "node").select(F.col("node").alias("start"), "last", *(F.col(c).alias(f"s_{c}") for c in names)), "starts", _rows())
    if told["n"] <= STARTS:
        both = level.join(F.broadcast(seeds), "last")
    else:
        from graphloom.operators.entities import meet

        both = meet(level, seeds, ["last"])
    found = F.coalesce(F.when(F.col("start") == F.col("node"), F.lit(0)), *(F.when(F.col(c) == F.col(f"s_{c}"), F.lit(w)) for c, w in zip(names, weights, strict=True)))
    return both.select("start", "node", found.cast("int").alias("w"))


def bottleneck_links(edges: DataFrame, starts: DataFrame, max_weight: int | None = None, follow_delayed: bool = False, mirrored: bool = False) -> DataFrame:
    """(start, node, w): the least, over all walks, of the heaviest edge on the walk; a delayed edge makes the walk delayed.

    Edges over ``max_weight`` are not followed, delayed ones only if asked. A start reaches itself at 0. A walk's
    rank is its heaviest edge's, but a delay outweighs every weight, so a walk is in one of two states and both are
    kept: with delay or without. A round joins what the last one improved and writes what it improves itself.
    ``mirrored``: all edges go both ways at one weight, so that, without delayed ones, components of each weight tell all.
    """
    fine = F.col("w") >= 0 if max_weight is None else (F.col("w") >= 0) & (F.col("w") <= max_weight)
    usable = written(add_weighted(edges).where(fine | (F.col("w") == -1) if follow_delayed else fine), "edges")
    if mirrored and not follow_delayed:
        weights = sorted(r["w"] for r in usable.select("w").distinct().limit(LEVELS + 1).collect())
        if len(weights) <= LEVELS:
            return _by_levels(usable, starts.select(F.col(starts.columns[0]).alias("start")).distinct(), weights)
    fresh, told = written_with(starts.select(F.col(starts.columns[0]).alias("start"), F.col(starts.columns[0]).alias("node"), F.lit(0).alias("w")).distinct(), "links", _rows())
    known, key = fresh, ["start", "node", "d"]
    keyed = lambda rows: rows.groupBy("start", "node", (F.col("w") == -1).alias("d")).agg(F.min("w").alias("w"))
    while told["n"]:
        step = fresh.select("start", F.col("node").alias("src"), F.col("w").alias("so_far")).join(usable, "src")
        walk = F.when((F.col("so_far") == -1) | (F.col("w") == -1), F.lit(-1)).otherwise(F.greatest("so_far", "w"))
        found = keyed(step.select("start", F.col("dst").alias("node"), walk.alias("w")))
        better = found.join(keyed(known).withColumnRenamed("w", "old"), key, "left").where("old is null or w < old").select("start", "node", "w")
        fresh, told = written_with(better, "links", _rows())
        known = known.unionByName(fresh)
    return known.groupBy("start", "node").agg(weight_of(F.min(rank_of(F.col("w")))).alias("w"))


def clusters(edges: DataFrame, lowest: int, highest: int, one_way: str | None = None) -> DataFrame:
    """(node, cluster): components over edges of a weight from ``lowest`` to ``highest``, by their smallest node.

    Edges that touch the node ``one_way`` merge nothing; it is a cluster of its own. All nodes of ``edges`` are
    in the result.
    """
    inside = F.col("w").between(lowest, highest)
    if one_way is not None:
        inside = inside & (F.col("src") != one_way) & (F.col("dst") != one_way)
    found = connected_components(edges.where(inside))
    return _nodes(edges).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def spread_over_clusters(values: DataFrame, cluster: DataFrame, break_delay: bool = False) -> DataFrame:
    """(node, v): each node's value becomes the largest of its cluster, a delay outweighing it unless delays are broken."""
    from graphloom.functions.lattice import most, most_ignoring_delay

    joined = cluster.join(values, "node", "left")
    each = joined.groupBy("cluster").agg((most_ignoring_delay if break_delay else most)(F.col("v")).alias("v"))
    return cluster.join(each, "cluster").select("node", "v")


def reaches_flag(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """G20, RM2: the nodes from which a flagged node is reached, itself included: a flag goes against the edges to a fixpoint."""
    return reaches(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), flagged)


def call_facts(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Per method what its calls reach within its own type, and who reaches it.

    ``calls``: src, dst (methods); ``methods``: method, type, is_private, is_ctor, is_static, is_abstract. Gives method,
    n_own_reached, static_calls_only, from_non_private, from_constructor, on_call_cycle, status: a method that no
    own method reaches is part of construction or not at all.
    """
    own = methods.select("method", "type")
    inside = calls.join(own.select(F.col("method").alias("src"), F.col("type").alias("t1")), "src").join(own.select(F.col("method").alias("dst"), F.col("type").alias("t2")), "dst").where("t1 = t2").select("src", "dst").distinct()
    reach = written(closure(inside, include_start=False), "reach")
    is_static = methods.select(F.col("method").alias("node"), "is_static")
    reached = reach.join(is_static, "node").groupBy(F.col("start").alias("method")).agg(F.count(F.lit(1)).alias("n_own_reached"), F.bool_and("is_static").alias("static_calls_only"), F.bool_or(F.col("start") == F.col("node")).alias("on_call_cycle"))
    callers = methods.select(F.col("method").alias("start"), "is_private", "is_ctor")
    by = reach.join(callers, "start").groupBy(F.col("node").alias("method")).agg(F.bool_or(~F.col("is_private") & ~F.col("is_ctor")).alias("from_non_private"), F.bool_or("is_ctor").alias("from_constructor"))
    no = F.lit(False)
    out = methods.join(reached, "method", "left").join(by, "method", "left").select(
        "method", "is_private", F.coalesce("n_own_reached", F.lit(0)).alias("n_own_reached"), F.coalesce("static_calls_only", F.lit(True)).alias("static_calls_only"),
        F.coalesce("on_call_cycle", no).alias("on_call_cycle"), F.coalesce("from_non_private", no).alias("from_non_private"), F.coalesce("from_constructor", no).alias("from_constructor"),
    )
    status = F.when(~F.col("is_private"), F.lit("non_private")).when(F.col("from_non_private"), F.lit("called_from_non_private")).when(F.col("from_constructor"), F.lit("part_of_construction")).otherwise(F.lit("not_called"))
    return out.select("*", status.alias("status"))
