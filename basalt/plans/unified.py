"""One query over tables, vectors and a graph: each part is a ranked frame, and the parts are fused in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators.graph import Graph, bfs, trade_graph
from basalt.operators.vector import search
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

#: Weights of the parts in the fused score (fixed values).
WEIGHTS = {"sql": 0.4, "vector": 0.3, "graph": 0.3}

#: Rows of the sql part whose place counts; the others score a half.
RANKED = 50


@dataclass
class UnifiedQuery:
    """Parts that are None are left out; sql is (id, …) rows in order_by order, vector is (frame, query vector), graph is (graph, start ids)."""

    sql: tuple[DataFrame, str] | None = None
    vector: tuple[DataFrame, list[float]] | None = None
    graph: tuple[Graph, DataFrame] | None = None
    top_k: int = 10
    depth: int = 3

    @property
    def mode(self) -> str:
        """Which parts are asked for, such as 'sql+vector'."""
        return "+".join(n for n in WEIGHTS if getattr(self, n) is not None)


def fuse(query: UnifiedQuery, weights: dict[str, float] | None = None) -> DataFrame:
    """id and score, the greatest weighted score of any part.

    The i-th row of the sql part scores 1 - min(i / 100, 0.5); a vector its similarity; a node at some depth 1 - min(depth / 10, 0.9).
    """
    weights = weights or WEIGHTS
    parts: list[DataFrame] = []
    if query.sql:
        rows, order = query.sql
        # Rows beyond the first RANKED score alike: they need no rank, and of them the least ids come first in a top-k report.
        top = rows.orderBy(F.expr(order), "id").limit(RANKED)
        rank = F.row_number().over(Window.orderBy(F.expr(order), "id")) - 1
        top = top.select("id", (weights["sql"] * (1 - rank / (2 * RANKED))).alias("score"))
        rest = rows.select("id").join(F.broadcast(top.select("id")), "id", "left_anti").distinct().orderBy("id").limit(query.top_k)
        parts += [top, rest.select("id", F.lit(weights["sql"] * 0.5).alias("score"))]
    if query.vector:
        frame, q = query.vector
        parts.append(search(frame, q, query.top_k, "cosine").select("id", (weights["vector"] * F.col("score")).alias("score")))
    if query.graph:
        graph, start = query.graph
        reached = bfs(graph, start, query.depth)
        parts.append(reached.select("id", (weights["graph"] * (1 - F.least(F.col("distance") / 10, F.lit(0.9)))).alias("score")))
    if not parts:
        raise ValueError("a unified query needs a part")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(query.top_k)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    graph = trade_graph(spark, sf_dir)
    rich = load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal")
    q = UnifiedQuery((rich, "-c_acctbal"), (vectors, list(vectors.filter("id = 0").first().v)), (graph, spark.range(7, 8)), top_k=20)
    return fuse(q).select("id", F.round("score", 6).alias("score"))


OPERATORS["unified_query"] = Operator(
    _run,
    """WITH s AS (SELECT c_custkey AS id, 0.4 * (1 - least((row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) / 100.0::DOUBLE, 0.5)) AS score FROM customer),
 q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
 v AS (SELECT vec_id AS id, 0.3 * list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20),
 g AS (SELECT 7 AS id, 0.3 AS score UNION ALL SELECT c_nationkey + 2000000000, 0.3 * 0.9 FROM customer WHERE c_custkey = 7 UNION ALL SELECT n_regionkey + 1000000000, 0.3 * 0.8 FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 7)
 SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM v UNION ALL SELECT * FROM g) GROUP BY id ORDER BY max(score) DESC, id LIMIT 20""", "3.4")
