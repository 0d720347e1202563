"""From the scaffold graph to paths: transitive reduction, chains, the best weight threshold, names.

Graphs here are sets of edges (src, dst, d, n) between oriented contigs, both strands stored. Every step works on all components, and
on all thresholds of a sweep (`by` columns), at once. Chains take a number of rounds that grows with the logarithm of the longest; the
transitive reduction contracts chains first and takes a number that grows with the depth of forks. Their state is written to the shared folder, so lineage
stays short and lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import flip
from ..functions.shared import stage, unstage


def weight_sweep(edges: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """Edges of each threshold w from least to most: those with n >= w."""
    return edges.withColumn("w", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.col("n").cast("int")))))


def transitive_reduction(edges: DataFrame, by: list[str] = []) -> DataFrame:
    """Drops each edge whose target can be reached from its source without it, by a route of any length that doesn't come back to the
    source.

    Only edges whose source has another way out and whose target has another way in are open. In each round edges with a way round over
    one node are dropped, and so are those that lead no further than paths through the graph do, alone or over one other edge between
    them; what is left without forks is contracted, a whole chain to one node; and ends that no open edge touches go. The graph so
    loses nothing of what can be reached, and rounds grow with the depth of its forks, not with the length of chains.
    Where a round changes little, the open edges left are walked on the contracted graph. What remains when ends are peeled off it lies
    on cycles: there, a way round may have been taken out together with the edge that it leads round, so open edges at such nodes are
    walked on the whole graph."""
    one = stage(edges.select(*by, "src", "dst").filter("src <> dst").distinct())
    key = [*by, "src", "dst"]
    graph, dropped, maps, before = one.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", F.lit(True).alias("open")), [], [], None
    while True:
        ends = _with_degrees(graph, by)
        useless = ((F.col("into_a") == 0) & ~F.col("open_a")) | ((F.col("out_b") == 0) & ~F.col("open_b"))
        left = stage(ends.filter(~useless).withColumn("open", F.col("open") & (F.col("out_a") > 1) & (F.col("into_b") > 1)))
        ways = stage(_over_one_node(left, by))
        judged, path, places = _along_paths(left, ways, by)
        dropped.append(stage(judged.filter("open AND (short OR over)").select(*key)))
        graph, places = _contracted(judged.filter("NOT over").select(*by, "a", "b", "src", "dst", (F.col("open") & ~F.col("short")).alias("open")), path, places, by)
        maps += places
        now = graph.agg(F.count(F.lit(1)), F.count_if("open")).first()
        if not now[1]:
            break
        if before and now[0] > before[0] / 2:  # little was contracted
            merged = _without_twins(graph, by)
            if merged is None or (n := merged.count()) > now[0] * 0.75:
                found = _walked(graph, graph.filter("open"), by)
                dropped.append(stage(graph.join(found, [*by, "a", "b"], "left_semi").select(*key)))
                break
            graph, now = merged, (n, now[1])
        before = now
    graph, left = _peeled(graph, by), now[0]
    while left and (n := graph.count()) != left:
        graph, left = _peeled(graph, by), n
    if left:
        core = stage(graph.select(*by, F.col("a").alias("node")).union(graph.select(*by, F.col("b").alias("node"))).distinct())
        for places in reversed(maps):
            inner = places.join(core.withColumnRenamed("node", "head"), [*by, "head"], "left_semi").select(*by, "node")
            core = stage(core.union(inner).distinct())
        plain = one.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"))
        touched = [plain.join(core.withColumnRenamed("node", end), [*by, end], "left_semi") for end in ("a", "b")]
        many = _with_degrees(touched[0].unionByName(touched[1]).distinct().withColumn("open", F.lit(True)), by, plain).filter("out_a > 1 AND into_b > 1")
        dropped.append(stage(_walked(plain, many.select(*by, "a", "b"), by).toDF(*key)))
    gone = dropped[0]
    for more in dropped[1:]:
        gone = gone.union(more)
    return edges.join(gone, key, "left_anti")


def _with_degrees(graph: DataFrame, by: list[str], of: DataFrame | None = None) -> DataFrame:
    """Edges (a, b, open) with the number of ways out of a and of b and into them, in the graph itself or in `of`, and whether an open
    edge leaves a, or comes to b."""
    of = graph if of is None else of.withColumn("open", F.lit(True))
    one = lambda end, n, is_open: of.groupBy(*by, end).agg(F.count(F.lit(1)).alias(n), F.max("open").alias(is_open))
    outs, into = one("a", "out_a", "open_a"), one("b", "into_b", "open_b")
    out = graph.join(outs, [*by, "a"]).join(into, [*by, "b"])
    out = out.join(outs.select(*by, F.col("a").alias("b"), F.col("out_a").alias("out_b")), [*by, "b"], "left")
    out = out.join(into.select(*by, F.col("b").alias("a"), F.col("into_b").alias("into_a")), [*by, "a"], "left")
    return out.na.fill(0, ["out_b", "into_a"])


def _over_one_node(graph: DataFrame, by: list[str]) -> DataFrame:
    """Edges (a, b) for which there are edges (a, m) and (m, b). Of a's ways out and b's ways in the fewer are tried."""
    forks = graph.filter("out_a > 1 AND into_b > 1").select(*by, "a", "b", "out_a", "into_b")
    plain = graph.select(*by, "a", "b")
    out = forks.filter("out_a <= into_b").select(*by, "a", "b").join(plain.withColumnRenamed("b", "m"), [*by, "a"]).filter("m <> a AND m <> b")
    found = out.join(plain.withColumnRenamed("a", "m"), [*by, "m", "b"], "left_semi").select(*by, "a", "b")
    into = forks.filter("out_a > into_b").select(*by, "a", "b").join(plain.withColumnRenamed("a", "m"), [*by, "b"]).filter("m <> a AND m <> b")
    return found.union(into.join(plain.withColumnRenamed("b", "m"), [*by, "a", "m"], "left_semi").select(*by, "a", "b")).distinct()


def _links(graph: DataFrame, by: list[str]) -> DataFrame:
    """Edges (a, b) that are the only way out of a and the only way into b."""
    outs = graph.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")
    into = graph.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")
    return graph.join(outs, [*by, "a"], "left_semi").join(into, [*by, "b"], "left_semi").select(*by, "a", "b")


def _along_paths(graph: DataFrame, ways: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with two marks: short (one of `ways`), and over: it goes ahead on a path without being a step of it, or from one path to
    another, where another edge leaves the first no earlier and comes to the second no later. And the paths' steps and places.

    Steps are edges, none of `ways`, that are the only one out of a or into b, one at most out of and into each node. Of the edges
    that are over, each leads no further than one that is not, so they can all be left out at once."""
    rest = graph.select(*by, "a", "b").join(ways, [*by, "a", "b"], "left_anti")
    outs, into = (rest.groupBy(*by, end).agg(F.count(F.lit(1)).alias(f"n_{end}")) for end in ("a", "b"))
    forced = rest.join(outs, [*by, "a"]).join(into, [*by, "b"]).filter("n_a = 1 OR n_b = 1").select(*by, "a", "b")
    one_out = forced.groupBy(*by, "a").agg(F.min("b").alias("b"))
    path = stage(one_out.groupBy(*by, "b").agg(F.min("a").alias("a")).select(*by, "a", "b"))
    places = _places(path, by)
    placed = _at(_at(graph, places, by, "a"), places, by, "b").join(path.withColumn("is_step", F.lit(True)), [*by, "a", "b"], "left").join(ways.withColumn("short", F.lit(True)), [*by, "a", "b"], "left")
    ahead = (F.col("a_head") == F.col("b_head")) & (F.col("a_step") < F.col("b_step"))
    w = Window.partitionBy(*by, "a_head", "b_head").orderBy(F.desc("a_step"), "b_step").rowsBetween(Window.unboundedPreceding, -1)
    nearer = (F.col("a_head") != F.col("b_head")) & (F.coalesce(F.min("b_step").over(w), F.col("b_step") + 1) <= F.col("b_step"))
    over = F.col("is_step").isNull() & (ahead | nearer)
    return stage(placed.select(*by, "a", "b", "src", "dst", "open", F.coalesce("short", F.lit(False)).alias("short"), over.alias("over"))), path, places


def _at(df: DataFrame, places: DataFrame, by: list[str], end: str) -> DataFrame:
    """df with <end>_head and <end>_step, the chain and the place of the node in column `end`; a node in no chain is one of its own."""
    of = places.select(*by, F.col("node").alias(end), F.col("head").alias(f"{end}_head"), F.col("step").alias(f"{end}_step"))
    return df.join(of, [*by, end], "left").withColumn(f"{end}_head", F.coalesce(f"{end}_head", end)).na.fill(0, [f"{end}_step"])


def _contracted(graph: DataFrame, path: DataFrame, places: DataFrame, by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The graph with each chain without forks as one node, named by its first, and tables (node, head) of what went into which. The
    places on paths serve again where the chains are the paths."""
    links = stage(_links(graph, by))
    n = links.count()
    if not n:
        return stage(graph), []
    if n != path.count() or not links.join(path, [*by, "a", "b"], "left_anti").isEmpty():
        places = _places(links, by)
    inner = links.join(places.filter("NOT closed").select(*by, F.col("node").alias("a")), [*by, "a"], "left_semi")
    left = _at(_at(graph.join(inner, [*by, "a", "b"], "left_anti"), places, by, "a"), places, by, "b")
    return stage(left.select(*by, F.col("a_head").alias("a"), F.col("b_head").alias("b"), "src", "dst", "open")), [places]


def _places(links: DataFrame, by: list[str]) -> DataFrame:
    """(node, head, step, closed) of the nodes of chains of links: their chain's first node and their place from 0. Nodes of closed
    chains have themselves as head. Pointers to earlier nodes are doubled, two doublings a staged round."""
    nodes = links.select(*by, F.col("a").alias("node")).union(links.select(*by, F.col("b").alias("node"))).distinct()
    back = links.select(*by, F.col("b").alias("node"), F.col("a").alias("up"))
    state = stage(nodes.join(back, [*by, "node"], "left").select(*by, "node", F.coalesce("up", "node").alias("head"), F.col("up").isNotNull().cast("long").alias("step"), F.col("up").isNull().alias("done")))
    left = state.filter("NOT done").count()
    while left:
        new = state
        for _ in range(2):
            up = new.select(*by, F.col("node").alias("head"), F.col("head").alias("head2"), F.col("step").alias("step2"), F.col("done").alias("done2"))
            new = new.join(up, [*by, "head"]).select(*by, "node", F.when(F.col("done"), F.col("head")).otherwise(F.col("head2")).alias("head"), F.when(F.col("done"), F.col("step")).otherwise(F.col("step") + F.col("step2")).alias("step"), (F.col("done") | F.col("done2")).alias("done"))
        new = stage(new)
        unstage(state)
        state, before = new, left
        left = state.filter("NOT done").count()
        if left == before:  # a start would be twice as near by now: closed
            break
    return state.select(*by, "node", F.when(F.col("done"), F.col("head")).otherwise(F.col("node")).alias("head"), F.when(F.col("done"), F.col("step")).otherwise(0).alias("step"), (~F.col("done")).alias("closed"))


def _without_twins(graph: DataFrame, by: list[str]) -> DataFrame | None:
    """The graph with one node of those that have the same only way in and the same only way out; None if there are none such."""
    into = graph.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("c"), F.first("a").alias("before")).filter("c = 1").select(*by, F.col("b").alias("node"), "before")
    outs = graph.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("c"), F.first("b").alias("after")).filter("c = 1").select(*by, F.col("a").alias("node"), "after")
    inner = into.join(outs, [*by, "node"])
    first = inner.groupBy(*by, "before", "after").agg(F.min("node").alias("kept"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    more = stage(inner.join(first, [*by, "before", "after"]).filter("node <> kept").select(*by, "node"))
    if more.isEmpty():
        return None
    for end in ("a", "b"):
        graph = graph.join(more.withColumnRenamed("node", end), [*by, end], "left_anti")
    return stage(graph)


def _peeled(graph: DataFrame, by: list[str], times: int = 2) -> DataFrame:
    """The edges (a, b) that are left when those from nodes without a way in and those to nodes without a way out go, a few times."""
    graph = graph.select(*by, "a", "b")
    for _ in range(times):
        graph = graph.join(graph.select(*by, F.col("b").alias("a")).distinct(), [*by, "a"], "left_semi").select(*by, "a", "b")
        graph = graph.join(graph.select(*by, F.col("a").alias("b")).distinct(), [*by, "b"], "left_semi").select(*by, "a", "b")
    return stage(graph)


def _walked(graph: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Those of the edges `wanted` (a, b) whose b is reached from a without them, not by way of a again. All are walked at once, an edge
    of the graph a round, each node once; a round writes what is new alone."""
    edge = [*by, "a", "b"]
    step = graph.select(*by, F.col("a").alias("at"), F.col("b").alias("to"))
    wanted = wanted.select(*edge)
    front = stage(wanted.join(step.withColumnRenamed("at", "a"), [*by, "a"]).filter("to <> b AND to <> a").select(*edge, F.col("to").alias("at")).distinct())
    seen, met, rounds = front, front.limit(0).select(*edge), 0
    while not front.isEmpty():
        onward = front.join(met, edge, "left_anti").join(step, [*by, "at"]).filter("to <> a").select(*edge, F.col("to").alias("at")).distinct()
        front = stage(onward.join(seen, [*edge, "at"], "left_anti"))
        rounds += 1
        seen = seen.union(front) if rounds % 16 else stage(seen.union(front))
        met = stage(met.union(front.filter("at = b").select(*edge)))
    return met


def unambiguous(edges: DataFrame, by: list[str] = []) -> DataFrame:
    """Edges that are the only one of largest n both out of their source and into their target. Where the largest n is shared at a
    fork, no edge of that side is kept."""
    for end in ("src", "dst"):
        w = Window.partitionBy(*by, end)
        edges = edges.withColumn("top", F.max("n").over(w)).withColumn("ties", F.count_if(F.col("n") == F.col("top")).over(w))
        edges = edges.withColumn(f"best_{end}", (F.col("n") == F.col("top")) & (F.col("ties") == 1)).drop("top", "ties")
    return edges.filter("best_src AND best_dst").drop("best_src", "best_dst")


def chains(edges: DataFrame, by: list[str] = []) -> DataFrame:
    """Nodes of chains, in order: by..., start, step (from 0), node, gap_after (d of the edge that follows, null at the end).

    Edges have one way in and one way out at most. Each node's pointer to an earlier node is doubled until all point to a start; nodes
    on cycles never do and are left out."""
    edges = stage(edges)
    places = _places(edges.select(*by, F.col("src").alias("a"), F.col("dst").alias("b")), by).filter("NOT closed")
    onward = edges.select(*by, F.col("src").alias("node"), F.col("d").alias("gap_after"))
    return places.join(onward, [*by, "node"], "left").select(*by, F.col("head").alias("start"), "step", "node", "gap_after")


def one_strand(paths: DataFrame, by: list[str] = []) -> DataFrame:
    """Keeps of each path and its reverse complement the one whose first contig is smaller than its last. A path that begins and
    ends with the same contig is kept on neither strand."""
    contig = F.expr("left(node, length(node) - 1)")
    w = Window.partitionBy(*by, "start")
    ends = paths.withColumn("a", F.min_by(contig, "step").over(w)).withColumn("b", F.max_by(contig, "step").over(w))
    return ends.filter("a < b").drop("a", "b")


def written_gap(d: str, least: int) -> Column:
    """A gap as path files have it, one more than the real one; null after the last contig (greatest() would pass over the null)."""
    return F.when(F.col(d).isNotNull(), F.greatest(d, F.lit(least)) + 1)


def layout(edges: DataFrame, by: list[str] = [], min_gap: int = 20) -> DataFrame:
    """Paths: by..., start, step, contig, ori, gap (max(d, min_gap) + 1 before the next contig, null at the end), d."""
    return laid_out(unambiguous(transitive_reduction(edges, by), by), by, min_gap)


def laid_out(best: DataFrame, by: list[str] = [], min_gap: int = 20) -> DataFrame:
    """Paths, as layout() gives them, of edges with one way in and one way out at most."""
    paths = one_strand(chains(best, by), by)
    return paths.select(*by, "start", "step", F.expr("left(node, length(node) - 1)").alias("contig"), F.expr("right(node, 1)").alias("ori"), written_gap("gap_after", min_gap).alias("gap"), F.col("gap_after").alias("d"))


def scaffold_lengths(paths: DataFrame, lengths: DataFrame, by: list[str] = []) -> DataFrame:
    """Lengths of the scaffolds that paths make, gaps without their extra base, and of contigs in no path."""
    placed = paths.join(lengths, "contig")
    made = placed.groupBy(*by, "start").agg((F.sum("length") + F.sum(F.coalesce(F.col("gap") - 1, F.lit(0)))).cast("long").alias("length")).select(*by, "length")
    if not by:
        return made.union(lengths.join(paths.select("contig"), "contig", "left_anti").select(F.col("length").cast("long")))
    keys = paths.select(*by).distinct()  # few: the thresholds
    alone = lengths.join(F.broadcast(keys)).join(paths.select(*by, "contig"), [*by, "contig"], "left_anti")
    return made.union(alone.select(*by, F.col("length").cast("long")))


def n50(lengths: DataFrame, by: list[str] = [], share: float = 0.5) -> DataFrame:
    """The first length, in descending order, at which the running sum reaches the share. Sums are made by distinct length first."""
    each = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(F.desc("length"))
    run = each.withColumn("reached", F.sum(F.col("c") * F.col("length")).over(w)).withColumn("total", F.sum(F.col("c") * F.col("length")).over(Window.partitionBy(*by)))
    return run.filter(F.col("reached") >= F.col("total") * share).groupBy(*by).agg(F.max("length").alias("n50"))


def optimal_weight(edges: DataFrame, lengths: DataFrame, least: int = 1, most: int = 10, min_gap: int = 20) -> DataFrame:
    """N50 of each threshold's layout: w, n50, best (largest n50, the smallest w of equal ones)."""
    return optimal_of(unambiguous(transitive_reduction(weight_sweep(edges, least, most), ["w"]), ["w"]), lengths, min_gap)


def optimal_of(best: DataFrame, lengths: DataFrame, min_gap: int = 20) -> DataFrame:
    """optimal_weight() of the layout edges of each threshold w."""
    found = n50(scaffold_lengths(laid_out(best, ["w"], min_gap), lengths, ["w"]), ["w"])
    top = F.max(F.struct("n50", (-F.col("w")).alias("m"))).over(Window.partitionBy())  # a row for each threshold
    return found.select("w", "n50", (-top["m"] == F.col("w")).alias("best"))


#: Path ids are this and a number; a parameter, so that ids of other tools can be matched.
PREFIX = "scaffold_"


def named_paths(paths: DataFrame, first: int = 0, prefix: str = PREFIX) -> DataFrame:
    """Paths with ids <prefix><i> from `first` on, in descending order of (number of nodes, first node). Paths are dealt by range of
    that order; a path's number is the count of all parts before its own, one small row a part, and its place in its part."""
    one = paths.groupBy("start").agg((2 * F.count(F.lit(1)) - 1).alias("nodes"), F.min_by(F.concat("contig", "ori"), "step").alias("head"))
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(one.repartitionByRange(parts, F.desc("nodes"), F.desc("head")).withColumn("part", F.spark_partition_id()))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("nodes"), F.desc("head")))
    ids = dealt.withColumn("place", place).join(base, "part").select("start", F.concat(F.lit(prefix), (F.col("place") + F.col("base") + first - 1).cast("string")).alias("path_id"))
    return paths.join(ids, "start").drop("start")


def cap_gap(paths: DataFrame, most: int) -> DataFrame:
    """Gaps of at most `most` (+ 1 as written in paths); -1 sets no limit."""
    return paths if most == -1 else paths.withColumn("gap", F.when(F.col("gap").isNotNull(), F.least("gap", F.lit(most + 1))))


def path_lines(paths: DataFrame) -> DataFrame:
    """path_id and the path as text: oriented contigs with `<gap>N` between them."""
    node = F.concat("contig", "ori", F.coalesce(F.concat(F.lit(" "), F.col("gap").cast("string"), F.lit("N")), F.lit("")))
    steps = F.array_sort(F.collect_list(F.struct("step", node.alias("node"))))
    return paths.groupBy("path_id").agg(F.array_join(F.transform(steps, lambda s: s["node"]), " ").alias("path"))


def parse_path_lines(lines: DataFrame) -> DataFrame:
    """The inverse of path_lines(): path_id, step, contig, ori, gap."""
    nodes = lines.select("path_id", F.posexplode(F.split("path", " ")).alias("at", "node"))
    w = Window.partitionBy("path_id").orderBy("at")
    nodes = nodes.withColumn("next", F.lead("node").over(w)).filter(F.col("at") % 2 == 0)
    gap = F.regexp_extract("next", r"^(\d+)N$", 1)
    return nodes.select("path_id", (F.col("at") / 2).cast("long").alias("step"), F.expr("left(node, length(node) - 1)").alias("contig"), F.expr("right(node, 1)").alias("ori"), F.when(gap != "", gap.cast("int")).alias("gap"))


def path_edges(paths: DataFrame) -> DataFrame:
    """Directed edges of paths, both strands: src, dst, d (the real gap)."""
    w = Window.partitionBy("path_id").orderBy("step")
    on = paths.withColumn("c2", F.lead("contig").over(w)).withColumn("o2", F.lead("ori").over(w)).filter("c2 IS NOT NULL")
    there = on.select(F.concat("contig", "ori").alias("src"), F.concat("c2", "o2").alias("dst"), (F.col("gap") - 1).alias("d"))
    return there.union(on.select(F.concat("c2", flip(F.col("o2"))), F.concat("contig", flip(F.col("ori"))), F.col("gap") - 1))


# stitching: paths of other thresholds mend the best one's


def stitch_candidates(best: DataFrame, others: DataFrame) -> DataFrame:
    """Edges of other layouts (file, src, dst, d) that join what the best one leaves open: src has no way out and dst no way in there.
    Contigs that the best one lacks have neither. d is the median cut towards 0, n the number of layouts with the edge."""
    out = best.select(F.col("src")).distinct()
    into = best.select(F.col("dst")).distinct()
    free = others.join(best.select("src", "dst"), ["src", "dst"], "left_anti").join(out, "src", "left_anti").join(into, "dst", "left_anti")
    return free.groupBy("src", "dst").agg(F.median("d").cast("int").alias("d"), F.countDistinct("file").alias("n"))


def linearize(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, n, new) left after forks are settled, targets first and then sources: where all edges at a fork are new, the
    only one of largest n stays, if there is one; else all new ones go."""
    for end in ("dst", "src"):
        w = Window.partitionBy(end)
        e = edges.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("old", F.count_if(~F.col("new")).over(w)).withColumn("top", F.max("n").over(w))
        e = e.withColumn("ties", F.count_if(F.col("n") == F.col("top")).over(w))
        keep = (F.col("c") == 1) | F.when(F.col("old") > 0, ~F.col("new")).otherwise((F.col("n") == F.col("top")) & (F.col("ties") == 1))
        edges = e.filter(keep).drop("c", "old", "top", "ties")
    return edges


def neighbourhood_edges(paths: DataFrame, reach: int = 4) -> DataFrame:
    """Pairs of contigs of a path at most `reach` steps apart: path_id, src, dst, apart."""
    w = Window.partitionBy("path_id").orderBy("step")
    later = F.array(*(F.struct(F.lit(i).alias("apart"), F.lead(F.concat("contig", "ori"), i).over(w).alias("dst")) for i in range(1, reach + 1)))
    on = paths.select("path_id", F.concat("contig", "ori").alias("src"), later.alias("later"))
    return on.select("path_id", "src", F.explode("later").alias("e")).select("path_id", "src", "e.dst", "e.apart").filter("dst IS NOT NULL")


def window_edges(paths: DataFrame, supported: DataFrame, graph: DataFrame, neighbourhood: int = 4) -> DataFrame:
    """Edges (src, dst, both strands) that paths add to a graph around each step that `supported` (src, dst) lacks: from each of the
    step's first node and `neighbourhood` nodes before it to each of its second node and as many after it, without the step itself and
    what the graph has."""
    at = paths.select("path_id", "step", F.concat("contig", "ori").alias("node"))
    w = Window.partitionBy("path_id").orderBy("step")
    steps = at.withColumn("dst", F.lead("node").over(w)).filter("dst IS NOT NULL").withColumnRenamed("node", "src")
    bare = steps.join(supported.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("path_id", "step")
    before = bare.withColumn("at", F.explode(F.sequence(F.col("step") - neighbourhood, F.col("step"))))
    both = before.withColumn("to", F.explode(F.sequence(F.col("step") + 1, F.col("step") + 1 + neighbourhood))).filter("to - at > 1").select("path_id", "at", "to").distinct()
    pairs = both.join(at.select("path_id", F.col("step").alias("at"), F.col("node").alias("src")), ["path_id", "at"]).join(at.select("path_id", F.col("step").alias("to"), F.col("node").alias("dst")), ["path_id", "to"])
    new = pairs.select("src", "dst").join(graph.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    turned = lambda v: F.concat(F.expr(f"left({v}, length({v}) - 1)"), flip(F.expr(f"right({v}, 1)")))
    return new.union(new.select(turned("dst"), turned("src"))).distinct()


def transitive_support(path: DataFrame, graph: DataFrame) -> DataFrame:
    """Steps of paths with the number of graph edges that span them: from any node before the step or its first one to any after or its
    second one, however far, the step's own edge left out. Each edge counts up where it begins and down where it ends, so long edges
    make no more rows than short ones."""
    at = path.select("path_id", "step", F.concat("contig", "ori").alias("node"))
    w = Window.partitionBy("path_id").orderBy("step")
    near = graph.select("src", "dst").join(at.select("path_id", F.col("node").alias("src"), F.col("step").alias("s0")), "src")
    near = near.join(at.select("path_id", F.col("node").alias("dst"), F.col("step").alias("s1")), ["path_id", "dst"]).filter("s1 - s0 > 1")
    turns = near.select("path_id", F.col("s0").alias("step"), F.lit(1).alias("c")).union(near.select("path_id", "s1", F.lit(-1))).groupBy("path_id", "step").agg(F.sum("c").alias("c"))
    steps = at.withColumn("dst", F.lead("node").over(w)).join(turns, ["path_id", "step"], "left")
    return steps.withColumn("support", F.sum(F.coalesce("c", F.lit(0))).over(w)).filter("dst IS NOT NULL").select("path_id", "step", F.col("node").alias("src"), "dst", "support")


def transitive_filter(edges: DataFrame, graph: DataFrame) -> DataFrame:
    """Edges (src, dst, d, n, new) of chains without those new ones that no graph edge supports. A step is supported by an edge from
    before it to beyond it, or by two: one from its first node to beyond it and one from before it to its second node. Edges that lie
    on a cycle are in no chain and go if they are new."""
    at = stage(chains(edges).select("start", "step", "node"))
    on = lambda end, step: at.select("start", F.col("node").alias(end), F.col("step").alias(step))
    spans = graph.select("src", "dst").distinct().join(on("src", "s0"), "src").join(on("dst", "s1"), ["start", "dst"]).filter("s1 - s0 > 1")
    event = lambda step, over, out, into: F.struct(F.expr(step).alias("step"), F.lit(over).alias("over"), F.lit(out).alias("out"), F.lit(into).alias("into"))
    turns = spans.select("start", F.inline(F.array(event("s0", 1, 1, 0), event("s1", -1, 0, 0), event("s1 - 1", 0, 0, 1))))
    turns = turns.groupBy("start", "step").agg(*(F.sum(c).alias(c) for c in ("over", "out", "into")))
    steps = at.join(turns, ["start", "step"], "left").na.fill(0, ["over", "out", "into"])
    steps = steps.withColumn("over", F.sum("over").over(Window.partitionBy("start").orderBy("step")))
    held = steps.filter("over > out + into OR (out > 0 AND into > 0)").select(F.col("node").alias("src"), F.lit(True).alias("held"))
    return edges.join(held, "src", "left").filter("NOT new OR held").drop("held")
