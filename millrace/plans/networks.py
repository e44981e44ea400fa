"""Queries on the co-purchase graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import views as V
from .registry import SQL, query, sql

_E = ("rv", "r", "cp", "th", "e")
_S = (*_E, "sy")
DEPTH = 40


@query("SELECT u, v, n FROM cp", "rv", "r", "cp")
def copair_count(spark, d):
    return V.pairs(spark, d)


@query("SELECT u, v FROM e", *_E)
def graph_edges(spark, d):
    return V.edges(spark, d)


@query("SELECT u, v FROM sy", *_S)
def graph_symmetric_edges(spark, d):
    return G.symmetric(V.edges(spark, d))


@query("SELECT DISTINCT u AS node FROM sy", *_S)
def graph_vertices(spark, d):
    return G.vertices(V.edges(spark, d))


@query("SELECT u AS node, array_to_string(list_sort(list(v)), ',') AS neighbours FROM sy GROUP BY u", *_S)
def adjacency(spark, d):
    return G.adjacency(V.edges(spark, d)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("SELECT u AS node, count(*) AS degree FROM sy GROUP BY u", *_S)
def degree(spark, d):
    return G.degree(V.edges(spark, d))


_CC = "SELECT root AS node, min(node) AS component FROM reach GROUP BY root"
_REACH = ", reach AS (SELECT DISTINCT u AS root, u AS node FROM sy UNION SELECT root, v FROM reach JOIN sy ON node = u) "


@query()
def connected_components(spark, d):
    e = V.edges(spark, d)
    return G.components(e, G.vertices(e))


def _lpa(rounds: int) -> str:
    out = ", l0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS label FROM sy)"
    for k in range(1, rounds + 1):
        out += f", l{k} AS MATERIALIZED (SELECT node, label FROM (SELECT u AS node, label, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, label) AS k FROM sy JOIN l{k - 1} ON node = v GROUP BY u, label) WHERE k = 1)"
    return out + f" SELECT len(m) AS size, array_to_string(m, ',') AS members FROM (SELECT list_sort(list(node)) AS m FROM l{rounds} GROUP BY label)"


@query()
def lpa_communities(spark, d):
    return G.communities(G.label_propagation(V.edges(spark, d), 5)).withColumn("size", F.col("size").cast("long"))


def _bfs() -> str:
    out = ", d0 AS MATERIALIZED (SELECT DISTINCT u AS root, u AS node, 0 AS dist, CAST(1 AS DOUBLE) AS sigma FROM sy)"
    for k in range(1, DEPTH + 1):
        old = f"SELECT root, node FROM d{k - 1}" + (f" UNION ALL SELECT root, node FROM d{k - 2}" if k > 1 else "")
        out += f", d{k} AS MATERIALIZED (SELECT n.root, n.node, {k} AS dist, n.sigma FROM (SELECT root, v AS node, sum(sigma) AS sigma FROM d{k - 1} JOIN sy ON node = u GROUP BY 1, 2) n ANTI JOIN ({old}) o ON n.root = o.root AND n.node = o.node)"
    return out + ", p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(DEPTH + 1)) + ")"


_BT = ", bt AS MATERIALIZED (SELECT least(e.u, e.v) AS u, greatest(e.u, e.v) AS v, sum(a.sigma * b.sigma / c.sigma) / 2 AS x FROM sy e JOIN p a ON a.node = e.u JOIN p b ON b.node = e.v JOIN p c ON c.root = a.root AND c.node = b.root WHERE a.dist + 1 + b.dist = c.dist GROUP BY 1, 2)"


@query()
def bfs_distances(spark, d):
    return G.shortest_paths(V.edges(spark, d)).withColumn("dist", F.col("dist").cast("long"))


@query()
def edge_betweenness(spark, d):
    return G.edge_betweenness(V.edges(spark, d)).select("u", "v", F.round("betweenness", 5).alias("betweenness"))


@query()
def max_betweenness_edges(spark, d):
    return G.max_edges(G.edge_betweenness(V.edges(spark, d))).select("u", "v", F.round("betweenness", 5).alias("betweenness"))


_MOD = ", c AS MATERIALIZED (SELECT root AS node, min(node) AS component FROM reach GROUP BY root), m AS (SELECT count(*) AS m FROM e), k AS (SELECT component, count(*) AS k FROM sy JOIN c ON u = node GROUP BY 1), l AS (SELECT component, count(*) AS l FROM e JOIN c ON u = node GROUP BY 1) SELECT round(sum(coalesce(l, 0) / m - power(k / (2 * m), 2)), 6) AS q FROM k LEFT JOIN l USING (component), m"


@query()
def modularity(spark, d):
    e = V.edges(spark, d)
    return G.modularity(e, G.components(e, G.vertices(e))).select(F.round("q", 6).alias("q"))


@query()
def girvan_newman_communities(spark, d):
    g = G.girvan_newman(V.edges(spark, d))
    return G.communities(g, "component").withColumn("size", F.col("size").cast("long"))


_BASE = sql("", *_S).rstrip()
SQL["connected_components"] = _BASE + _REACH + _CC
SQL["lpa_communities"] = _BASE + _lpa(5)
SQL["bfs_distances"] = _BASE + _bfs() + " SELECT * FROM p"
SQL["edge_betweenness"] = _BASE + _bfs() + _BT + " SELECT u, v, round(x, 5) AS betweenness FROM bt"
SQL["max_betweenness_edges"] = _BASE + _bfs() + _BT + " SELECT u, v, round(x, 5) AS betweenness FROM bt WHERE x >= (SELECT max(x) FROM bt) - 1e-7"
SQL["modularity"] = _BASE + _REACH + _MOD
