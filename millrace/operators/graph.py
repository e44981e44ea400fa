"""Co-occurrence graphs, label propagation, shortest paths, betweenness, modularity, Girvan-Newman.

Edges are (u, v) rows with u < v; loops cut lineage with ``cut`` (default: checkpoint, in the shared folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .cooccur import co_counts

TOLERANCE = 1e-7


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def copairs(df: DataFrame, node: str, item: str) -> DataFrame:
    """(u, v, n): how many items two nodes share."""
    return co_counts(df, item, node).toDF("u", "v", "n")


def top_edges(df: DataFrame, node: str, item: str, least: int) -> DataFrame:
    """:func:`edges_with` over :func:`copairs`. All pairs are counted, those that can't reach the threshold aren't kept."""
    return edges_with(_cut(co_counts(df, item, node, top=least).toDF("u", "v", "n")), least)


def threshold_with(pairs: DataFrame, least: int) -> DataFrame:
    """One row (t): the largest count that at least ``least`` pairs reach."""
    by = pairs.groupBy("n").agg(F.count("*").alias("c"))
    run = by.select("n", F.sum("c").over(Window.orderBy(F.desc("n"))).alias("c"))  # one row for each distinct count
    return run.where(F.col("c") >= least).agg(F.max("n").alias("t"))


def edges_with(pairs: DataFrame, least: int) -> DataFrame:
    """Edges: the pairs that reach :func:`threshold_with`."""
    return pairs.join(F.broadcast(threshold_with(pairs, least)), F.col("n") >= F.col("t")).select("u", "v")  # one row


def symmetric(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select("v", "u"))


def vertices(e: DataFrame) -> DataFrame:
    return symmetric(e).select(F.col("u").alias("node")).distinct()


def degree(e: DataFrame) -> DataFrame:
    return symmetric(e).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def adjacency(e: DataFrame) -> DataFrame:
    return symmetric(e).groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def components(e: DataFrame, nodes: DataFrame | None = None, cut=_cut) -> DataFrame:
    """(node, component); nodes without edges are components of their own."""
    c = connected_components(e, checkpoint=cut)
    return c if nodes is None else nodes.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def label_propagation(e: DataFrame, rounds: int = 5, cut=_cut) -> DataFrame:
    """(node, label) after synchronous rounds: each node takes its neighbours' most frequent label, the least of equals."""
    s = cut(symmetric(e).repartition("v"))
    labels = s.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    for _ in range(rounds):
        votes = s.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("u").alias("node")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, members) of each group, in the report's order."""
    c = labels.groupBy(label).agg(F.array_sort(F.collect_list("node")).alias("m"))
    return c.select(F.size("m").alias("size"), F.array_join("m", ",").alias("members")).orderBy("size", "members")


def shortest_paths(e: DataFrame, max_depth: int = 1000, cut=_cut) -> DataFrame:
    """(root, node, dist, sigma) from every node: distances and numbers of shortest paths, level by level.

    Paths longer than ``max_depth`` are an error. A level excludes nodes of the two levels before it, which in an undirected graph is all that it can meet again.
    """
    s = cut(symmetric(e))
    level = s.select(F.col("u").alias("root"), F.col("u").alias("node")).distinct().select("root", "node", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"))
    out, before = level, level.limit(0)
    for d in range(1, max_depth + 2):
        step = level.join(s, level["node"] == s["u"]).groupBy("root", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
        seen = level.select("root", "node").union(before.select("root", "node"))
        nxt = cut(step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("dist"), "sigma"))
        if nxt.isEmpty():
            break
        if d > max_depth:
            raise RuntimeError(f"paths are longer than {max_depth}")
        out, before, level = out.union(nxt), level, nxt
    return cut(out)


def edge_betweenness(e: DataFrame, cut=_cut, paths: DataFrame | None = None) -> DataFrame:
    """(u, v, betweenness): for each root, credit flows back level by level, split by path counts; halved over roots."""
    p = paths if paths is not None else shortest_paths(e, cut=cut)
    s = symmetric(e)
    # (root, child w, parent v, share) for all edges between neighbouring levels
    v = p.select("root", F.col("node").alias("v"), F.col("dist").alias("dv"), F.col("sigma").alias("sv"))
    w = p.select("root", F.col("node").alias("w"), F.col("dist").alias("dw"), F.col("sigma").alias("sw"))
    down = cut(v.join(s.toDF("v", "w"), "v").join(w, ["root", "w"]).where("dw = dv + 1").select("root", "v", "w", "dw", (F.col("sv") / F.col("sw")).alias("share")))
    deepest = down.agg(F.max("dw")).first()[0] or 0
    flow, credit = None, None
    for d in range(deepest, 0, -1):
        step = down.where(F.col("dw") == d)
        own = step if credit is None else step.join(credit, ["root", "w"], "left")
        got = F.lit(1.0) if credit is None else 1 + F.coalesce("c", F.lit(0.0))
        now = cut(own.select("root", "v", "w", (got * F.col("share")).alias("x")))
        flow = now if flow is None else flow.union(now)
        credit = now.groupBy("root", F.col("v").alias("w")).agg(F.sum("x").alias("c"))
    if flow is None:
        return e.select("u", "v", F.lit(0.0).alias("betweenness"))
    return flow.groupBy(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).agg((F.sum("x") / 2).alias("betweenness"))


def max_edges(b: DataFrame) -> DataFrame:
    """All edges tied at the greatest betweenness."""
    top = b.agg(F.max("betweenness").alias("m"))
    return b.join(F.broadcast(top), F.col("betweenness") >= F.col("m") - TOLERANCE).drop("m")  # one row


def modularity(e: DataFrame, labels: DataFrame, skip_singletons: bool = False) -> DataFrame:
    """One row (q): sum over communities of L / m - (K / 2m)^2; labels: (node, component)."""
    m = e.agg(F.count("*").alias("m"))
    k = degree(e).join(labels, "node").groupBy("component").agg(F.sum("degree").alias("k"), F.count("*").alias("size"))
    a, b = labels.toDF("u", "cu"), labels.toDF("v", "cv")
    inner = e.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("component")).agg(F.count("*").alias("l"))
    t = k.join(inner, "component", "left").join(F.broadcast(m))  # one row
    if skip_singletons:
        t = t.where("size > 1")
    return t.agg(F.coalesce(F.sum(F.coalesce(F.col("l"), F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))


def girvan_newman(e: DataFrame, max_cuts: int = 1000, cut=_cut, paths_of=None) -> DataFrame:
    """(node, component, q) of the communities where modularity on the original graph last rose (equal goes on).

    Each turn cuts all edges tied at the greatest betweenness; it ends at the first fall, or without edges; more than
    ``max_cuts`` turns are an error.
    """
    e = cut(e.select("u", "v"))
    nodes = cut(vertices(e))
    best = cut(components(e, nodes, cut))
    q = modularity(e, best).first()["q"]
    left = e
    for k in range(max_cuts + 1):
        if left.isEmpty():
            break
        if k == max_cuts:
            raise RuntimeError(f"not ended after {max_cuts} cuts")
        gone = max_edges(cut(edge_betweenness(left, cut)))
        left = cut(left.join(gone.select("u", "v"), ["u", "v"], "left_anti"))
        now = cut(components(left, nodes, cut))
        qn = modularity(e, now).first()["q"]
        if qn < q - 1e-12:
            break
        best, q = now, qn
    return best.withColumn("q", F.lit(float(q)))
