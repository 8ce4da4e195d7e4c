"""The registry of queries: one entry per operator, with the SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basalt.session import register_views


@dataclass(frozen=True)
class Operator:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    section: str = ""


OPERATORS: dict[str, Operator] = {}


def sql_operator(name: str, section: str, spark_sql: str, oracle: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Register a query given as Spark SQL; oracle defaults to the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, *tables)
        return spark.sql(spark_sql)

    OPERATORS[name] = Operator(run, oracle or spark_sql, section)


sql_operator(
    "tpch_q1",
    "2.4",
    """
    SELECT l_returnflag, l_linestatus, CAST(sum(qty) AS DOUBLE) AS sum_qty, CAST(sum(price) AS DOUBLE) AS sum_base_price,
           CAST(sum(price * (1 - disc)) AS DOUBLE) AS sum_disc_price, CAST(sum(price * (1 - disc) * (1 + tax)) AS DOUBLE) AS sum_charge,
           CAST(sum(qty) AS DOUBLE) / count(*) AS avg_qty, CAST(sum(price) AS DOUBLE) / count(*) AS avg_price,
           CAST(sum(disc) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
    FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(8, 2)) AS qty, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price,
                 CAST(l_discount AS DECIMAL(3, 2)) AS disc, CAST(l_tax AS DECIMAL(3, 2)) AS tax
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00') AS l
    GROUP BY l_returnflag, l_linestatus
    """,
    tables=("lineitem",),
)
