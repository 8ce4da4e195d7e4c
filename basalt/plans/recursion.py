"""Fixpoints that Spark's WITH RECURSIVE does not take: UNION (distinct) recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load
from basalt.sources.shared import checkpointed


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """All distinct rows of seed and of step applied to new rows, until none is new.

    Every round joins only the rows that the last one added, and cuts its lineage. Beyond max_rounds it raises.
    """
    every = checkpointed(seed.distinct())
    fresh = every
    for _ in range(max_rounds):
        fresh = checkpointed(step(fresh).distinct().exceptAll(every).distinct())
        if fresh.isEmpty():
            return every
        every = checkpointed(every.union(fresh))
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "nation").selectExpr("n_nationkey AS a", "(n_nationkey * 3 + 1) % 25 AS b")
    return fixpoint(edges, lambda fresh: fresh.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"))


OPERATORS["recursive_union_distinct"] = Operator(
    _closure,
    "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c", "2.7")
