"""Graph operators over edge tables (src, dst): bounded reachability, paths, cycles, degrees and layers.

Loops run on the driver, one job a round; each round's frontier is written to the shared folder, so the
lineage stays short. Frontiers carry nodes (or paths where paths are asked for), never whole graphs.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.operators import hops
from sedimark.storage import staged

#: Targets of a node that move in one row.
CHUNK = 1024
#: Rounds after which what a search has seen is written as one table, so that its plan stays short.
SEEN_ROUNDS = 16


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def reachable(edges: DataFrame, start: DataFrame, direction: str = "forward", max_depth: int = 10) -> DataFrame:
    """(node, depth): nodes within ``max_depth`` steps of ``start`` (node) and the fewest steps, start at 0."""
    step = staged(_directed(edges, direction), "reach-edges")
    seen = staged(start.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = staged(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % SEEN_ROUNDS == 0:
            seen = staged(seen, "reach")
    return seen


def call_chain_sql(edges_view: str, start: int, max_depth: int) -> str:
    """Bounded reachability as a recursive query; walks repeat on cycles, so for small depths only."""
    return f"""
    WITH RECURSIVE chain(node, depth) AS (
      SELECT CAST({start} AS BIGINT), 0
      UNION ALL
      SELECT e.dst, c.depth + 1 FROM chain c JOIN {edges_view} e ON e.src = c.node WHERE c.depth < {max_depth})
    SELECT DISTINCT node FROM chain WHERE node <> {start}"""


def simple_paths(edges: DataFrame, start: DataFrame, max_depth: int, end: DataFrame | None = None) -> DataFrame:
    """(path, steps): simple paths from ``start`` of 1 to ``max_depth`` steps, to ``end`` (node) if given."""
    step = staged(_directed(edges, "forward"), "path-edges")
    frontier = start.select(F.array("node").alias("path")).distinct()
    out = None
    for steps in range(1, max_depth + 1):
        met = frontier.join(step, F.element_at("path", -1) == step["src"]).filter(~F.array_contains("path", F.col("dst")))
        frontier = staged(met.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        part = frontier.select("path", F.lit(steps).alias("steps"))
        out = part if out is None else out.unionByName(part)
    if end is not None:
        out = out.join(end.select("node"), F.element_at("path", -1) == F.col("node"), "left_semi")
    return out


def shortest_paths(edges: DataFrame, start: DataFrame, end: DataFrame, max_depth: int) -> DataFrame:
    """All simple paths of the least number of steps."""
    found = simple_paths(edges, start, max_depth, end)
    return found.join(found.agg(F.min("steps").alias("steps")), "steps", "left_semi")


def _chunked(edges: DataFrame) -> DataFrame:
    """(src, chunk, outs): the targets of each node by arrays of up to ``CHUNK``, counted from 0."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return edges.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("src", "chunk").agg(F.collect_list("dst").alias("outs"))


def cycles(edges: DataFrame, max_length: int = 3) -> DataFrame:
    """(path, length): cycles of up to ``max_length`` nodes, each once, beginning at its smallest node.

    Paths are listed up to the last node but one; last nodes are those that the path's end points at and that point at its
    beginning, found where the two arrays of neighbours meet, so longest paths that close no cycle are never rows.
    """
    step = staged(_directed(edges, "forward").filter("src is not null and dst is not null"), "cycle-edges")
    out = step.filter("src = dst").select(F.array("src").alias("path"), F.lit(1).alias("length"))
    frontier = step.filter("src < dst").select(F.array("src", "dst").alias("path"))
    if max_length > 1:
        both = step.filter("src < dst").join(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
        out = out.unionByName(both.select(F.array("src", "dst").alias("path"), F.lit(2).alias("length")))
    if max_length > 2:
        outs = staged(_chunked(step), "cycles").select(F.col("src").alias("last"), "outs")
        ins = _chunked(step.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ins = staged(ins, "cycles").select(F.col("src").alias("first"), F.col("outs").alias("ins"))
    for length in range(3, max_length + 1):
        open_ = frontier.select("path", F.col("path")[0].alias("first"), F.element_at("path", -1).alias("last"))
        met = open_.join(ins, "first").join(outs, "last")
        closing = met.select("path", F.explode(F.array_except(F.array_intersect("ins", "outs"), "path")).alias("dst"))
        out = out.unionByName(closing.select(F.concat("path", F.array("dst")).alias("path"), F.lit(length).alias("length")))
        if length < max_length:
            longer = frontier.join(step, F.element_at("path", -1) == step["src"])
            longer = longer.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst")))
            frontier = staged(longer.select(F.concat("path", F.array("dst")).alias("path")), "cycles")
    return out


def strong_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of nodes on a cycle: strongly connected components of two or more nodes, by smallest node.

    Each round drops nodes without an edge in or out, spreads the largest node id forwards, and takes from each
    root the nodes that reach it backwards within its colour.
    """
    left = staged(_directed(edges, "forward").filter("src <> dst"), "scc")
    done = None
    n = left.count()
    for _ in range(max_rounds):
        while n:
            ends = left.select(F.col("src").alias("node")).distinct().intersect(left.select(F.col("dst").alias("node")).distinct())
            left = left.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
            left = staged(left.select("src", "dst"), "scc")
            before, n = n, left.count()
            if n == before:
                break
        if n == 0:
            break
        colour = staged(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "scc")
        while True:
            pushed = left.join(colour, left["src"] == colour["node"]).groupBy("dst").agg(F.max("colour").alias("c"))
            new = colour.join(pushed, colour["node"] == pushed["dst"], "left").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("grown"))
            new = staged(new, "scc")
            colour = new.drop("grown")
            if new.filter("grown").isEmpty():
                break
        a, b = (colour.select(F.col("node").alias(e), F.col("colour").alias(f"{e}_colour")) for e in ("src", "dst"))
        same = staged(left.join(a, "src").join(b, "dst").filter("src_colour = dst_colour").select("src", "dst"), "scc")
        roots = colour.filter("node = colour").select("node", F.col("node").alias("root"))
        member = frontier = staged(roots, "scc")
        for k in count(1):
            back = frontier.join(same, frontier["node"] == same["dst"]).select(F.col("src").alias("node"), "root").distinct()
            frontier = staged(back.join(member, ["node", "root"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            member = member.unionByName(frontier)
            if k % SEEN_ROUNDS == 0:
                member = staged(member, "scc")
        member = staged(member, "scc")
        done = member if done is None else done.unionByName(member)
        left = left.join(member.select(F.col("node").alias("src")), "src", "left_anti").join(member.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = staged(left.select("src", "dst"), "scc")
        n = left.count()
    else:
        raise RuntimeError("strong components did not settle")
    if done is None:
        return colourless(left)
    sized = done.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return done.join(sized, "root").select("node", "component")


def colourless(edges: DataFrame) -> DataFrame:
    """An empty component table of the right types."""
    return edges.filter(F.lit(False)).select(F.col("src").alias("node"), F.col("src").alias("component"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, centrality): distinct edges; centrality is (in + out) / (2 (n - 1))."""
    e = _directed(edges, "forward")
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    summed = both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("n"))
    joined = nodes.select("node").distinct().join(summed, "node", "left").join(F.broadcast(n))
    i, o = (F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree"))
    return joined.select("node", i.alias("in_degree"), o.alias("out_degree"), (F.when(F.col("n") > 1, (i + o) / (2 * (F.col("n") - 1))).otherwise(0.0)).alias("centrality"))


def graph_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, max and mean out-degree, entry points, leaves, isolated nodes."""
    return degrees(edges, nodes).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum("out_degree").alias("edges"),
        (F.sum("out_degree") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))).alias("density"),
        F.max("out_degree").alias("max_out"),
        F.avg("out_degree").alias("mean_out"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).alias("entry_points"),
        F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("leaves"),
        F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"),
    )


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing points at."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that point at nothing."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def only_used_by(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Nodes all of whose users are in ``users`` (node)."""
    marked = edges.join(users.select(F.col("node").alias("src"), F.lit(True).alias("is_user")), "src", "left")
    return marked.groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce("is_user", F.lit(False))).alias("all_in"), F.count(F.lit(1)).alias("uses")).filter("all_in").drop("all_in")


def critical_neighbours(edges: DataFrame, nodes: int = 5, neighbours: int = 3) -> DataFrame:
    """(node, neighbour): for the nodes with most edges, up to ``neighbours`` of what they are joined to, the least first."""
    e = _directed(edges, "forward")
    total = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    chosen = total.orderBy(F.desc("n"), "node").limit(nodes).select("node")
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    met = both.join(F.broadcast(chosen), "node").distinct()
    return met.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("neighbour")), 1, neighbours).alias("few")).select("node", F.explode("few").alias("neighbour"))


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (node, component, size, recursive) of strong components and the arcs (src, dst) between them, which have no cycle.

    A node that is on no cycle of two or more is a component by itself; ``recursive`` says that a cycle goes through the node, a loop included.
    """
    step = staged(_directed(edges, "forward"), "condense")
    nodes = step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct()
    placed = nodes.join(strong_components(step), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    loops = step.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = placed.join(sizes, "component").join(loops, "node", "left")
    members = staged(members.select("node", "component", "size", (F.coalesce("loop", F.lit(False)) | (F.col("size") > 1)).alias("recursive")), "condense")
    a, b = (members.select(F.col("node").alias(e), F.col("component").alias(f"{e}_component")) for e in ("src", "dst"))
    arcs = step.join(a, "src").join(b, "dst").filter("src_component <> dst_component")
    return members, staged(arcs.select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct(), "condense")


def _settled(members: DataFrame, arcs: DataFrame, max_rounds: int) -> DataFrame:
    """(component, depth): steps of the longest way from each component along the arcs, where a component of n nodes takes n - 1 steps.

    Each round settles the components all of whose targets are settled, the leaves first; there are as many rounds as a way has arcs.
    """
    sizes = members.select("component", "size").distinct()
    outward = arcs.groupBy(F.col("src").alias("component")).agg(F.count(F.lit(1)).alias("open"))
    waiting = sizes.join(outward, "component").select("component", "size", "open", F.lit(0).cast("long").alias("reach"))
    waiting = staged(waiting, "depths")
    ready = staged(sizes.join(outward, "component", "left_anti").select("component", (F.col("size") - 1).alias("depth")), "depths")
    done = ready
    for k in range(1, max_rounds + 1):
        met = arcs.join(ready, arcs["dst"] == ready["component"]).groupBy(F.col("src").alias("component"))
        met = met.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("depth") + 1).alias("via"))
        now = waiting.join(met, "component", "left").select(
            "component", "size", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("reach", F.coalesce("via", F.lit(0))).alias("reach")
        )
        now = staged(now, "depths")
        ready = now.filter("open = 0").select("component", (F.col("reach") + F.col("size") - 1).alias("depth"))
        if ready.isEmpty():
            return done
        waiting = now.filter("open > 0")
        done = done.unionByName(ready)
        if k % SEEN_ROUNDS == 0:
            done = staged(done, "depths")
    raise RuntimeError("ways have more arcs than rounds were allowed")


def longest_depths(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(node, depth, recursive): steps of the longest way from each node; 0 for leaves.

    Cycles of any length are allowed: they are condensed, and a component of n nodes counts n - 1 steps, the most that a way can take in it
    without meeting a node twice. Depths of nodes that reach no cycle are exact, the others are bounds from above; ``recursive`` marks nodes on
    a cycle.
    """
    members, arcs = condensed(edges)
    return members.join(_settled(members, arcs, max_rounds), "component").select("node", "depth", "recursive")


def longest_ways(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(src, dst, depth_left): the arcs between components that lie on a way of the greatest depth, all ties included.

    ``depth_left`` is the depth of ``src``, so a way is read by falling depth; components go by their smallest node. Ways are not listed one
    by one, of which there can be exponentially many.
    """
    members, arcs = condensed(edges)
    depth = staged(_settled(members, arcs, max_rounds).join(members.select("component", "size").distinct(), "component"), "ways")
    a = depth.select(F.col("component").alias("src"), F.col("depth").alias("depth_left"), "size")
    b = depth.select(F.col("component").alias("dst"), F.col("depth").alias("rest"))
    tight = staged(arcs.join(a, "src").join(b, "dst").filter("depth_left = size + rest").select("src", "dst", "depth_left"), "ways")
    top = depth.agg(F.max("depth").alias("depth"))
    starts = depth.join(F.broadcast(top), "depth").select(F.col("component").alias("node"))
    on_way = reachable(tight, starts, "forward", max_rounds)
    return tight.join(on_way.select(F.col("node").alias("src")), "src", "left_semi")


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, via, dst): indirect edges through one other node, without direct ones.

    Targets move as arrays of up to ``CHUNK``, eight bytes a way, and direct ones are taken off where they meet the source's own; only
    sources with more targets than that compare way by way.
    """
    e = staged(_directed(edges, "forward").filter("src is not null and dst is not null"), "two-hop")
    chunks = staged(_chunked(e), "two-hop")
    own = chunks.groupBy("src").agg(F.max("chunk").alias("last"), F.first("outs").alias("direct")).filter("last = 0").select("src", "direct")
    outs, first = chunks.select(F.col("src").alias("via"), "outs"), e.select("src", F.col("dst").alias("via"))
    ways, rest = (first.join(own, "src", how).join(outs, "via") for how in ("left_semi", "left_anti"))
    few = ways.join(own, "src").select("src", "via", F.explode(F.array_except("outs", F.concat("direct", F.array("src")))).alias("dst"))
    many = rest.select("src", "via", F.explode("outs").alias("dst")).filter("src <> dst")
    return few.unionByName(many.join(e, ["src", "dst"], "left_anti").select("src", "via", "dst"))


def _length_row(edges: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    pairs = sum(n for _, n in found)
    mean = sum(d * n for d, n in found) / pairs if pairs else None
    longest = max((d for d, n in found if n), default=None)
    return edges.sparkSession.createDataFrame([(pairs, mean, longest)], "pairs long, mean_length double, longest int")


def mean_path_length(edges: DataFrame, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """One row (pairs, mean_length, longest): mean fewest steps over ordered pairs (source, other reachable node); all nodes are sources without ``sources`` (node).

    Exact, and so quadratic in a component: a node keeps a bit for every node of its component (see ``hops``).
    """
    return _length_row(edges, hops.reached(edges, sources if sources is None else sources.select("node"), max_depth))


def approximate_path_length(edges: DataFrame, max_depth: int = 100, lg_k: int = 12) -> DataFrame:
    """One row (pairs, mean_length, longest): fewest steps over ordered pairs of a node and another that it reaches, approximately.

    Every node keeps a sketch of the nodes that it reaches; a round takes the sketches of its targets into it (see ``hops``), and what the
    estimates grow by are the pairs at that distance. The error of a count is about 1.04 / 2 ** (lg_k / 2), 1.6 % at 12; rounds end
    when no sketch changes.
    """
    return _length_row(edges, [(d, round(n)) for d, n in hops.sketched(edges, max_depth, lg_k)])


def match_pattern(edges: DataFrame, pattern: list[tuple[str, str, str]], distinct_nodes: bool = True) -> DataFrame:
    """Places where a pattern of several edges fits: one column a variable of ``pattern``, whose items are (variable, kind, variable).

    ``edges`` are (src, dst, kind). The edges of each kind are counted, and pattern edges are joined by rising count, always one that
    shares a variable with what is bound; an edge both of whose ends are bound closes by a semi join. ``distinct_nodes`` asks for different nodes.
    """
    typed = staged(edges.select("src", "dst", "kind").distinct(), "pattern-edges")
    counts = {r["kind"]: r["n"] for r in typed.filter(F.col("kind").isin([k for _, k, _ in pattern])).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = sorted(pattern, key=lambda e: counts.get(e[1], 0))
    out, bound = None, []
    while left:
        # Closing edges first: they only take rows away.
        ranked = sorted(left, key=lambda e: (not (e[0] in bound and e[2] in bound), not (e[0] in bound or e[2] in bound), counts.get(e[1], 0)))
        a, kind, b = ranked[0]
        left.remove(ranked[0])
        one = typed.filter(F.col("kind") == kind)
        one = one.filter("src = dst").select(F.col("src").alias(a)) if a == b else one.select(F.col("src").alias(a), F.col("dst").alias(b))
        fresh = [v for v in dict.fromkeys((a, b)) if v not in bound]
        if out is None:
            out = one
        elif not fresh:
            out = out.join(one, list(dict.fromkeys((a, b))), "left_semi")
        elif len(fresh) < len({a, b}):
            out = out.join(one, a if b in fresh else b)
        else:
            raise ValueError("the edges of a pattern must hang together")
        if distinct_nodes:
            for v in fresh:
                for w in [*bound, *(x for x in fresh if x < v)]:
                    out = out.filter(F.col(v) != F.col(w))
        bound += fresh
    return out.select(*bound)


def assign_layer(name: Column, layers: list[tuple[str, int, str]]) -> Column:
    """The first of ``layers`` (name, level, glob), by level, whose glob the name matches; else Unknown."""
    out = F.lit("Unknown")
    for layer, _, pattern in sorted(layers, key=lambda x: -x[1]):
        body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in " _" else c for c in pattern)
        out = F.when(name.rlike(f"(?i)^{body}$"), layer).otherwise(out)
    return out


def layer_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges with the layers of both ends; ``placed`` is (node, layer)."""
    a = placed.select(F.col("node").alias("src"), F.col("layer").alias("src_layer"))
    b = placed.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.join(a, "src").join(b, "dst")


def layer_violations(layered: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Edges that point up, from a level to a lower one; an unknown layer is always allowed."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    a, b = table[F.col("src_layer")], table[F.col("dst_layer")]
    bad = layered.filter(a.isNotNull() & b.isNotNull() & (a > b))
    severity = F.when(a - b > 1, "Major").otherwise("Minor")
    return bad.withColumn("severity", severity)


def compliance(layered: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Per source layer: edges, violations and the share of allowed edges in percent, to two places."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    a, b = table[F.col("src_layer")], table[F.col("dst_layer")]
    bad = F.coalesce(a > b, F.lit(False))
    return layered.groupBy("src_layer").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(bad).alias("violations"),
        F.round(100.0 * (1 - F.count_if(bad) / F.count(F.lit(1))), 2).alias("compliance"),
    )
