"""Data changes as pure functions of (old table, changes): nothing is updated in place.

Keys compare null-safely only where said; a key of NULL never matches another, as in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT: columns that rows lack become NULL; order of columns does not matter."""
    return target.unionByName(rows.select(*[c for c in rows.columns if c in target.columns]), allowMissingColumns=True).select(*target.columns)


def auto_increment(rows: DataFrame, column: str, start: int, order_by: Sequence[str]) -> DataFrame:
    """Gapless numbers after `start` in order_by order: per-part counts and a running number within parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *order_by).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by)) + F.col("_before") + start
    return parts.join(F.broadcast(offsets), "_part").withColumn(column, number.cast("bigint")).drop("_part", "_before")


def delete(target: DataFrame, condition: str) -> DataFrame:
    """DELETE … WHERE: rows for which the condition is FALSE or UNKNOWN stay."""
    return target.filter(~F.coalesce(F.expr(condition), F.lit(False)))


def update(target: DataFrame, assignments: Mapping[str, str], condition: str = "true") -> DataFrame:
    """UPDATE … SET: all assignments see the old row."""
    hit = F.coalesce(F.expr(condition), F.lit(False))
    return target.select(*[(F.when(hit, F.expr(assignments[c])).otherwise(F.col(c)) if c in assignments else F.col(c)).alias(c) for c in target.columns])


def last_per_key(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in order_by. Later changes win, as if applied one after the other."""
    w = Window.partitionBy(*keys).orderBy(*[(F.col(c) if isinstance(c, str) else c).desc() for c in order_by])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    matched_update: Mapping[str, str] | None = None,
    matched_delete: str | None = None,
    not_matched_insert: bool = True,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """MERGE INTO target USING source ON keys.

    Assignments and matched_delete may name t.<column> and s.<column>. Of several source rows for a
    key the last in order_by counts (all source columns break ties).
    """
    source = last_per_key(source, keys, [*order_by, *[c for c in source.columns if c not in (*keys, *order_by)]] or list(keys))
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    both = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    joined = t.join(s, on, "full" if not_matched_insert else "left")
    if matched_delete:
        joined = joined.filter(~(both & F.coalesce(F.expr(matched_delete), F.lit(False))))
    changes = matched_update or {}

    def value(c: str) -> Column:
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        changed = F.expr(changes[c]) if c in changes else F.col(f"t.{c}")
        return F.when(both, changed).when(F.col("_t").isNotNull(), F.col(f"t.{c}")).otherwise(new).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def replace_into(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """REPLACE INTO: rows with a matching key go, the new rows come (the last of each key)."""
    rows = last_per_key(rows, keys, [c for c in rows.columns if c not in keys] or list(keys))
    return target.join(rows.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], assignments: Mapping[str, str] | None = None) -> DataFrame:
    """ON DUPLICATE KEY UPDATE / ON CONFLICT DO UPDATE; by default every non-key column takes the new value."""
    assignments = assignments or {c: f"s.{c}" for c in rows.columns if c not in keys}
    return merge(target, rows, keys, matched_update=assignments)


# Constraints: frames of the rows that break them.


def check_violations(rows: DataFrame, condition: str) -> DataFrame:
    """Rows for which a CHECK condition is FALSE (UNKNOWN passes)."""
    return rows.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def unique_violations(rows: DataFrame, keys: Sequence[str], primary: bool = False) -> DataFrame:
    """Keys held more than once; NULLs are distinct under UNIQUE and forbidden under PRIMARY KEY."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.filter(null | (F.col("n") > 1)) if primary else counted.filter(~null & (F.col("n") > 1))


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = customers.filter("c_custkey % 3 = 0").selectExpr("c_custkey * 2 AS c_custkey", "concat('new ', c_name) AS c_name", "c_acctbal + 1 AS c_acctbal")
    return customers, source


_SOURCE = "(SELECT c_custkey * 2 AS k, 'new ' || c_name AS n, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 3 = 0) s"


def _register(name: str, section: str, oracle: str, run) -> None:
    OPERATORS[name] = Operator(run, oracle, section)


_register("dml_insert_select", "2.14", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, NULL FROM customer WHERE c_acctbal < 0",
          lambda spark, d: insert(_changes(spark, d)[0], _changes(spark, d)[0].filter("c_acctbal < 0").selectExpr("c_custkey + 1000000 AS c_custkey", "c_name")))
_register("dml_auto_increment", "2.14", "SELECT c_custkey, 100 + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id FROM customer",
          lambda spark, d: auto_increment(_changes(spark, d)[0].select("c_custkey", "c_acctbal"), "id", 100, ["c_acctbal", "c_custkey"]).select("c_custkey", "id"))
_register("dml_delete", "2.14", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT coalesce(nullif(c_custkey, 5) % 2 = 1, false)",
          lambda spark, d: delete(_changes(spark, d)[0], "nullif(c_custkey, 5) % 2 = 1"))
_register("dml_update", "2.14", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer",
          lambda spark, d: update(_changes(spark, d)[0], {"c_name": "upper(c_name)", "c_acctbal": "-c_acctbal"}, "c_acctbal < 0"))
_register("dml_update_join", "2.14", f"SELECT c_custkey, c_name, coalesce(s.b, c_acctbal) AS c_acctbal FROM customer LEFT JOIN {_SOURCE} ON c_custkey = s.k",
          lambda spark, d: merge(*_changes(spark, d), ["c_custkey"], {"c_acctbal": "s.c_acctbal"}, not_matched_insert=False))
_register("dml_merge", "2.14", f"SELECT coalesce(c_custkey, s.k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN s.n ELSE c_name END AS c_name, CASE WHEN c_custkey IS NULL OR s.k IS NOT NULL THEN s.b ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN {_SOURCE} ON c_custkey = s.k WHERE NOT (c_custkey IS NOT NULL AND s.k IS NOT NULL AND s.b < 0)",
          lambda spark, d: merge(*_changes(spark, d), ["c_custkey"], {"c_acctbal": "s.c_acctbal"}, matched_delete="s.c_acctbal < 0"))
_register("dml_replace_into", "2.14", f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s.k FROM {_SOURCE}) UNION ALL SELECT s.k, s.n, s.b FROM {_SOURCE}",
          lambda spark, d: replace_into(*_changes(spark, d), ["c_custkey"]))
_register("dml_upsert", "2.14", f"SELECT coalesce(c_custkey, s.k) AS c_custkey, coalesce(s.n, c_name) AS c_name, coalesce(s.b, c_acctbal) AS c_acctbal FROM customer FULL JOIN {_SOURCE} ON c_custkey = s.k",
          lambda spark, d: upsert(*_changes(spark, d), ["c_custkey"]))
_register("constraint_check", "2.2", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal >= 0, true)",
          lambda spark, d: check_violations(load(spark, d, "customer"), "c_acctbal >= 0").select("c_custkey"))
_register("constraint_unique", "2.2", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
          lambda spark, d: unique_violations(load(spark, d, "customer"), ["c_nationkey"]))
_register("constraint_foreign_key", "2.2", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
          lambda spark, d: foreign_key_violations(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer").filter("c_custkey % 5 <> 0"), "c_custkey").select("o_orderkey"))
