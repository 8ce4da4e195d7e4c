"""Quantified comparisons, value op ANY/ALL (subquery), with SQL's three-valued logic.

The subquery shrinks to one row (rows, non-null rows, least, greatest, distinct values), so no pair of rows is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load


def quantified(rows: DataFrame, value: str, op: str, quantifier: str, values: DataFrame, column: str, alias: str) -> DataFrame:
    """rows with the boolean `alias`: value op ANY|ALL (SELECT column FROM values). NULL is UNKNOWN.

    quantifier: any, some or all; op: = <> < <= > >=.
    """
    every = quantifier.lower() == "all"
    x = F.expr(value)
    c = F.col(column)
    one = values.agg(F.count("*").alias("_rows"), F.count(c).alias("_some"), F.min(c).alias("_min"), F.max(c).alias("_max"))
    joined = rows.crossJoin(F.broadcast(one))  # a single row
    low, high, n, some = F.col("_min"), F.col("_max"), F.col("_rows"), F.col("_some")
    if op in ("=", "<>", "!="):
        # = ANY and <> ALL ask for membership; = ALL and <> ANY whether all values are one.
        if (op == "=") != every:
            hit = values.select(c.alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn("_hit", F.lit(True))
            joined = joined.join(hit, x == F.col("_v"), "left").drop("_v")
            found: Column = F.col("_hit").isNotNull()
            result = F.when(n == 0, False).when(found, True).when(x.isNull() | (some < n), F.lit(None)).otherwise(False)
            result = ~result if every else result
        else:
            single = (low == high) & (x == low)
            result = F.when(n == 0, True).when(x.isNull(), F.lit(None)).when((some > 0) & ~single, False).when(some < n, F.lit(None)).otherwise(True)
            result = result if every else ~result
        return joined.withColumn(alias, result).drop("_rows", "_some", "_min", "_max", "_hit")
    against = (high if op[0] == ">" else low) if every else (low if op[0] == ">" else high)
    holds = {"<": x < against, "<=": x <= against, ">": x > against, ">=": x >= against}[op]
    if every:
        result = F.when(n == 0, True).when(x.isNull(), F.lit(None)).when((some > 0) & ~holds, False).when(some < n, F.lit(None)).otherwise(True)
    else:
        result = F.when(n == 0, False).when(x.isNull(), F.lit(None)).when((some > 0) & holds, True).when(some < n, F.lit(None)).otherwise(False)
    return joined.withColumn(alias, result).drop("_rows", "_some", "_min", "_max")


_CASES = [("gt_all", ">", "all"), ("le_any", "<=", "any"), ("eq_any", "=", "any"), ("ne_all", "<>", "all"), ("lt_all", "<", "all"), ("ge_some", ">=", "some")]


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(nullif(c_acctbal, 0) AS DOUBLE) AS b")
    values = load(spark, sf_dir, "supplier").selectExpr("s_acctbal AS v", "s_nationkey")
    for name, op, quantifier in _CASES:
        rows = quantified(rows, "b", op, quantifier, values.filter("s_nationkey < 5"), "v", name)
    return rows.drop("b")


_SQL = ", ".join(f"b {op} {'ANY' if q == 'some' else q.upper()} (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5) AS {n}" for n, op, q in _CASES)
OPERATORS["subquery_quantified"] = Operator(_run, f"SELECT c_custkey, {_SQL} FROM (SELECT c_custkey, nullif(c_acctbal, 0) AS b FROM customer)", "2.2")
