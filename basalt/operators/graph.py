"""Property graphs as two frames, nodes(id, label, props) and edges(src, dst, label): hops, BFS, paths, DFS and a Cypher subset."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

#: Rounds after which an iteration cuts its lineage.
CHECKPOINT_EVERY = 4


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def by_label(self, label: str) -> DataFrame:
        return self.nodes.filter(F.col("label") == label)

    def outgoing(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        """(id, neighbour) over edges that leave ids(id)."""
        edges = self.edges.filter(F.col("label") == label) if label else self.edges
        return ids.join(edges, F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbour"))

    def incoming(self, ids: DataFrame, label: str | None = None) -> DataFrame:
        edges = self.edges.filter(F.col("label") == label) if label else self.edges
        return ids.join(edges, F.col("id") == F.col("dst")).select("id", F.col("src").alias("neighbour"))


def _cut(df: DataFrame) -> DataFrame:
    from basalt.sources.shared import checkpointed

    return checkpointed(df)


def multi_hop(graph: Graph, start: DataFrame, hops: int, mode: str = "exact") -> DataFrame:
    """Distinct ids reached from start(id) by exactly `hops` edges, or within that many (mode 'within', without the start)."""
    at, seen = start.select("id").distinct(), None
    step = graph.edges.select(F.col("src").alias("id"), "dst")
    for _ in range(hops):
        at = at.join(step, "id").select(F.col("dst").alias("id")).distinct()
        seen = at if seen is None else seen.union(at)
    if mode == "within" and seen is not None:
        return seen.distinct().join(start.select("id"), "id", "left_anti")
    return at


def bfs(graph: Graph, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, distance, parent) of all ids reachable from start(id), within max_depth levels if given; the least parent of those one level up.

    One frontier join per level; visited ids are removed by an anti join; lineage is cut as it goes.
    """
    reached = _cut(start.select("id").distinct().withColumn("distance", F.lit(0)).withColumn("parent", F.lit(None).cast("bigint")))
    frontier = reached
    step = graph.edges.select(F.col("src").alias("parent"), F.col("dst").alias("to"))
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        found = frontier.select(F.col("id").alias("parent")).join(step, "parent").groupBy(F.col("to").alias("id")).agg(F.min("parent").alias("parent"))
        frontier = _cut(found.join(reached.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance"), "parent"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % CHECKPOINT_EVERY == 0:
            reached = _cut(reached)
    return reached


def path_to(tree: DataFrame, target: int) -> list[int]:
    """The ids on the path from a start to target in the result of bfs(), by one lookup per level."""
    path: list[int] = []
    at: int | None = target
    while at is not None:
        row = tree.filter(F.col("id") == at).select("parent").first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def dfs(graph: Graph, component: str = "component") -> DataFrame:
    """(component, id, discovered, finished) of a depth-first walk of every component, from its least id, neighbours ascending.

    DFS order is sequential by nature: each component is walked by one task, so this is for graphs of many modest
    components; edges carry their component in a column.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for src, dst in sorted(zip(part["src"], part["dst"], strict=True)):
            out.setdefault(src, []).append(dst)
            out.setdefault(dst, [])
        clock, when = 0, {}
        for root in sorted(out):
            if root in when:
                continue
            clock += 1
            when[root] = [clock, 0]
            stack = [(root, iter(out[root]))]
            while stack:
                node, rest = stack[-1]
                for nxt in rest:
                    if nxt not in when:
                        clock += 1
                        when[nxt] = [clock, 0]
                        stack.append((nxt, iter(out[nxt])))
                        break
                else:
                    clock += 1
                    when[node][1] = clock
                    stack.pop()
        name = part[component].iloc[0]
        return pd.DataFrame([(name, n, d, f) for n, (d, f) in when.items()], columns=["component", "id", "discovered", "finished"])

    return graph.edges.groupBy(component).applyInPandas(walk, "component bigint, id bigint, discovered bigint, finished bigint")


_PATTERN = re.compile(
    r"^\s*MATCH\s*\((?P<a>\w+)(?::(?P<al>\w+))?\)(?:\s*-\[(?P<r>\w+)?(?::(?P<rl>\w+))?\]->\s*\((?P<b>\w+)(?::(?P<bl>\w+))?\))?"
    r"(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<ret>.+?)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)


def cypher(graph: Graph, query: str) -> DataFrame:
    """MATCH (a:L)[-[r:T]->(b:M)] [WHERE …] RETURN a.x, b [LIMIT n]; properties are columns of nodes."""
    m = _PATTERN.match(query)
    if not m:
        raise ValueError(f"not understood: {query}")

    def side(name: str, label: str | None) -> DataFrame:
        rows = graph.nodes.filter(F.col("label") == label) if label else graph.nodes
        return rows.select(F.struct("*").alias(name))

    rows = side(m["a"], m["al"])
    if m["b"]:
        edges = graph.edges.filter(F.col("label") == m["rl"]) if m["rl"] else graph.edges
        edges = edges.select(F.struct("*").alias(m["r"] or "_r"))
        r = m["r"] or "_r"
        rows = rows.join(edges, F.col(f"{m['a']}.id") == F.col(f"{r}.src")).join(side(m["b"], m["bl"]), F.col(f"{m['b']}.id") == F.col(f"{r}.dst"))
    if m["where"]:
        rows = rows.filter(F.expr(m["where"]))
    columns = []
    for item in m["ret"].split(","):
        path = item.strip()
        columns.append(F.col(path if "." in path else f"{path}.id").alias(path.replace(".", "_")))
    rows = rows.select(*columns)
    return rows.limit(int(m["limit"])) if m["limit"] else rows


def lineage(edges: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """Ancestors (id, depth) of a record over parent pointers edges(child, parent)."""
    graph = Graph(edges, edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("label")))
    return bfs(graph, edges.sparkSession.createDataFrame([(start,)], "id bigint"), max_depth).select("id", F.col("distance").alias("depth"))


def descendants(edges: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """Records (id, depth) that come from a record over parent pointers edges(child, parent)."""
    return lineage(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), start, max_depth)


def broken_links(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Pointers (child, parent, problem) to a record that is not there, or from a record to itself."""
    known = records.select(F.col("id").alias("parent")).distinct().withColumn("known", F.lit(True))
    problem = F.when(F.col("child") == F.col("parent"), "self").when(F.col("known").isNull(), "missing")
    return edges.join(known, "parent", "left").select("child", "parent", problem.alias("problem")).filter("problem IS NOT NULL")


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations and customers as nodes; who belongs to whom as edges."""
    r = load(spark, sf_dir, "region").selectExpr("r_regionkey + 1000000000L AS id", "'Region' AS label", "r_name AS name", "CAST(NULL AS DOUBLE) AS balance")
    n = load(spark, sf_dir, "nation")
    c = load(spark, sf_dir, "customer")
    nodes = r.unionByName(n.selectExpr("n_nationkey + 2000000000L AS id", "'Nation' AS label", "n_name AS name", "CAST(NULL AS DOUBLE) AS balance"))
    nodes = nodes.unionByName(c.selectExpr("c_custkey AS id", "'Customer' AS label", "c_name AS name", "c_acctbal AS balance"))
    edges = n.selectExpr("n_nationkey + 2000000000L AS src", "n_regionkey + 1000000000L AS dst", "'IN' AS label")
    return Graph(nodes, edges.unionByName(c.selectExpr("c_custkey AS src", "c_nationkey + 2000000000L AS dst", "'LIVES' AS label")))


def _one(spark: SparkSession, i: int) -> DataFrame:
    return spark.range(i, i + 1)


_EDGES = "(SELECT n_nationkey::BIGINT + 2000000000 AS src, n_regionkey::BIGINT + 1000000000 AS dst FROM nation UNION ALL SELECT c_custkey, c_nationkey::BIGINT + 2000000000 FROM customer)"
OPERATORS["graph_neighbours"] = Operator(
    lambda spark, d: trade_graph(spark, d).outgoing(load(spark, d, "customer").selectExpr("c_custkey AS id"), "LIVES"),
    f"SELECT src AS id, dst AS neighbour FROM {_EDGES} WHERE src < 2000000000", "2.11")
OPERATORS["graph_incoming"] = Operator(
    lambda spark, d: trade_graph(spark, d).incoming(spark.range(2000000003, 2000000006)),
    f"SELECT dst AS id, src AS neighbour FROM {_EDGES} WHERE dst BETWEEN 2000000003 AND 2000000005", "2.11")
OPERATORS["graph_by_label"] = Operator(lambda spark, d: trade_graph(spark, d).by_label("Nation").select("id", "name"), "SELECT n_nationkey::BIGINT + 2000000000 AS id, n_name AS name FROM nation", "2.11")
OPERATORS["graph_two_hops"] = Operator(
    lambda spark, d: multi_hop(trade_graph(spark, d), load(spark, d, "customer").selectExpr("c_custkey AS id"), 2),
    f"SELECT DISTINCT b.dst AS id FROM {_EDGES} a JOIN {_EDGES} b ON a.dst = b.src WHERE a.src < 2000000000", "2.11")
OPERATORS["graph_within_hops"] = Operator(
    lambda spark, d: multi_hop(trade_graph(spark, d), _one(spark, 7), 2, "within"),
    f"SELECT a.dst AS id FROM {_EDGES} a WHERE a.src = 7 UNION SELECT b.dst FROM {_EDGES} a JOIN {_EDGES} b ON a.dst = b.src WHERE a.src = 7", "2.11")
OPERATORS["graph_bfs"] = Operator(
    lambda spark, d: bfs(Graph(None, trade_graph(spark, d).edges.selectExpr("dst AS src", "src AS dst")), _one(spark, 1000000001)).select("id", F.col("distance").cast("bigint").alias("distance"), "parent"),
    f"WITH RECURSIVE w(id, distance, parent) AS (SELECT 1000000001::BIGINT, 0::BIGINT, NULL::BIGINT UNION ALL SELECT e.src, distance + 1, e.dst FROM w JOIN {_EDGES} e ON e.dst = w.id) SELECT id, min(distance) AS distance, min(parent) AS parent FROM w GROUP BY id", "2.11")
OPERATORS["graph_cypher_nodes"] = Operator(lambda spark, d: cypher(trade_graph(spark, d), "MATCH (n:Customer) WHERE n.balance > 9000 RETURN n, n.name"), "SELECT c_custkey AS n, c_name AS n_name FROM customer WHERE c_acctbal > 9000", "2.11")
OPERATORS["graph_cypher_path"] = Operator(
    lambda spark, d: cypher(trade_graph(spark, d), "MATCH (c:Customer)-[:LIVES]->(n:Nation) WHERE c.balance > 8000 AND NOT n.name = 'NATION_3' RETURN c.name, n.name"),
    "SELECT c_name AS c_name, n_name AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000 AND NOT n_name = 'NATION_3'", "2.11")
OPERATORS["graph_dfs"] = Operator(
    lambda spark, d: dfs(Graph(None, load(spark, d, "nation").selectExpr("n_regionkey - 100L AS src", "CAST(n_nationkey AS BIGINT) AS dst", "CAST(n_regionkey AS BIGINT) AS component"))),
    """WITH c AS (SELECT n_regionkey::BIGINT AS component, n_nationkey::BIGINT AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
 SELECT component, id, 2 * i AS discovered, 2 * i + 1 AS finished FROM c UNION ALL SELECT component, component - 100, 1, 2 * count(*) + 2 FROM c GROUP BY component""", "2.11")
OPERATORS["graph_lineage"] = Operator(
    lambda spark, d: lineage(load(spark, d, "customer").selectExpr("c_custkey AS child", "c_custkey div 2 AS parent").filter("child > 0"), 1400).select("id", F.col("depth").cast("bigint").alias("depth")),
    "WITH RECURSIVE w(id, depth) AS (SELECT 1400::BIGINT, 0::BIGINT UNION ALL SELECT id // 2, depth + 1 FROM w WHERE id > 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = id)) SELECT id, depth FROM w", "2.11")
OPERATORS["graph_descendants"] = Operator(
    lambda spark, d: descendants(load(spark, d, "customer").selectExpr("c_custkey AS child", "c_custkey div 2 AS parent").filter("child > 0"), 3).select("id", F.col("depth").cast("bigint").alias("depth")),
    "WITH RECURSIVE w(id, depth) AS (SELECT 3::BIGINT, 0::BIGINT UNION ALL SELECT c_custkey, depth + 1 FROM w JOIN customer ON c_custkey // 2 = id AND c_custkey > 0) SELECT id, depth FROM w", "2.11")
OPERATORS["graph_broken_links"] = Operator(
    lambda spark, d: broken_links(load(spark, d, "customer").selectExpr("c_custkey AS child", "c_custkey * 2 AS parent"), load(spark, d, "customer").selectExpr("c_custkey AS id")),
    "SELECT c_custkey AS child, c_custkey * 2 AS parent, CASE WHEN c_custkey = 0 THEN 'self' ELSE 'missing' END AS problem FROM customer c WHERE c_custkey = 0 OR NOT EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey = c.c_custkey * 2)", "2.11")
