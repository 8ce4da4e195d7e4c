"""Row-level security, column masking and access policies, as rewrites of a frame before Catalyst sees it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load


@dataclass
class RowSecurity:
    """Predicates by (user, table); a user without one sees nothing of a protected table."""

    predicates: dict[tuple[str, str], str] = field(default_factory=dict)

    def grant(self, user: str, table: str, predicate: str) -> None:
        self.predicates[user, table] = predicate

    def apply(self, rows: DataFrame, user: str, table: str) -> DataFrame:
        if not any(t == table for _, t in self.predicates):
            return rows
        return rows.filter(F.expr(self.predicates.get((user, table), "false")))


#: Upper bounds of the masked ranges of numbers and their texts (fixed values).
RANGES = ((10_000, "< 10K"), (50_000, "10K - 50K"), (100_000, "50K - 100K"))
ABOVE = "> 100K"


def mask(column: Column, kind: str, custom: str | None = None) -> Column:
    """full, partial, hash, truncate, null, range or custom (an SQL expression); NULL stays NULL."""
    text = column.cast("string")
    n = F.length(text)
    if kind == "full":
        return F.when(column.isNotNull(), "****")
    if kind == "partial":
        seen = F.greatest(F.floor(n / 4), F.lit(1)).cast("int")
        middle = F.concat(F.left(text, seen), F.repeat(F.lit("*"), n - 2 * seen), F.right(text, seen))
        return F.when(n <= 2, "**").when(n <= 4, F.concat(F.lit("*"), F.right(text, F.lit(1)))).otherwise(middle)
    if kind == "hash":
        return F.sha2(text, 256)
    if kind == "truncate":
        return F.left(text, F.lit(3))
    if kind == "null":
        return F.lit(None).cast("string")
    if kind == "range":
        out = F.lit(ABOVE)
        for bound, name in reversed(RANGES):
            out = F.when(column < bound, name).otherwise(out)
        return F.when(column.isNotNull(), out)
    if kind == "custom" and custom:
        return F.expr(custom)
    raise ValueError(f"unknown mask {kind!r}")


def masked(rows: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rows with the columns of rules (column -> kind) masked."""
    return rows.select(*[(mask(F.col(c), rules[c]) if c in rules else F.col(c)).alias(c) for c in rows.columns])


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: object = None

    def column_expression(self) -> Column:
        c = F.col(self.column)
        ops = {
            "eq": lambda: c == self.value,
            "ne": lambda: c != self.value,
            "lt": lambda: c < self.value,
            "gt": lambda: c > self.value,
            "lte": lambda: c <= self.value,
            "gte": lambda: c >= self.value,
            "in": lambda: c.isin(*self.value),
            "not_in": lambda: ~c.isin(*self.value),
            "like": lambda: c.like(self.value),
            "is_null": lambda: c.isNull(),
            "is_not_null": lambda: c.isNotNull(),
        }
        return ops[self.op]()


def policy(rows: DataFrame, allow: Sequence[Sequence[Condition]], deny: Sequence[Sequence[Condition]] = ()) -> DataFrame:
    """Rows that some allow rule (all its conditions) admits and no deny rule hits."""

    def any_of(rules: Sequence[Sequence[Condition]]) -> Column:
        total = F.lit(False)
        for rule in rules:
            every = F.lit(True)
            for condition in rule:
                every = every & F.coalesce(condition.column_expression(), F.lit(False))
            total = total | every
        return total

    return rows.filter(any_of(allow) & ~any_of(deny))


def _secured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rls = RowSecurity()
    rls.grant("emea", "customer", "c_nationkey BETWEEN 5 AND 9")
    return rls.apply(load(spark, sf_dir, "customer"), "emea", "customer").select("c_custkey", "c_name")


OPERATORS["row_level_security"] = Operator(_secured, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey BETWEEN 5 AND 9", "2.2")
OPERATORS["column_masking"] = Operator(
    lambda spark, d: load(spark, d, "customer").select(
        "c_custkey", *[mask(F.col(c), k).alias(k) for c, k in (("c_name", "full"), ("c_mktsegment", "partial"), ("c_name", "hash"), ("c_mktsegment", "truncate"), ("c_name", "null"))], mask(F.col("c_acctbal") * 12, "range").alias("band")),
    """SELECT c_custkey, '****' AS "full", left(c_mktsegment, greatest(length(c_mktsegment) // 4, 1)) || repeat('*', length(c_mktsegment) - 2 * greatest(length(c_mktsegment) // 4, 1)) || right(c_mktsegment, greatest(length(c_mktsegment) // 4, 1)) AS partial,
    sha256(c_name) AS hash, left(c_mktsegment, 3) AS truncate, NULL::VARCHAR AS "null",
    CASE WHEN c_acctbal * 12 < 10000 THEN '< 10K' WHEN c_acctbal * 12 < 50000 THEN '10K - 50K' WHEN c_acctbal * 12 < 100000 THEN '50K - 100K' ELSE '> 100K' END AS band FROM customer""", "2.2")
OPERATORS["policy_filter"] = Operator(
    lambda spark, d: policy(load(spark, d, "customer"), [[Condition("c_mktsegment", "in", ["BUILDING", "MACHINERY"])], [Condition("c_acctbal", "gt", 9000)]], [[Condition("c_nationkey", "lte", 3)]]).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal > 9000) AND NOT c_nationkey <= 3", "2.17")
