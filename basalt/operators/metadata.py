"""Statistics, information schema, plans and statement fingerprints as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import TABLES, load, register_views


def analyze(rows: DataFrame) -> DataFrame:
    """column_name, row_count, null_count, distinct_count, min_value, max_value of every atomic column, in one aggregation."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    aggregates: list[Column] = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        aggregates += [F.count(c).alias(f"c{i}"), F.countDistinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    one = rows.agg(*aggregates)
    parts = [
        F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value"))
        for i, c in enumerate(names)
    ]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def information_tables(spark: SparkSession) -> DataFrame:
    """table_name and table_type of the session's tables and views."""
    rows = [(t.name, "VIEW" if t.isTemporary else t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string")


def information_columns(spark: SparkSession, *tables: str) -> DataFrame:
    """table_name, ordinal_position, column_name, data_type, is_nullable; also the rows of DESCRIBE."""
    rows = [
        (t, i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t in tables for i, f in enumerate(spark.table(t).schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal_position bigint, column_name string, data_type string, is_nullable string")


def explain(df: DataFrame) -> DataFrame:
    """The formatted physical plan as rows (line, plan)."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return df.sparkSession.createDataFrame(list(enumerate(text.split("\n"), 1)), "line bigint, plan string")


def fingerprint(sql: Column) -> Column:
    """A statement with literals as ?, lower case and single blanks: what statements alike share."""
    s = F.regexp_replace(sql, r"'(?:[^'\\]|''|\\.)*'", "?")
    s = F.regexp_replace(s, r"\b\d+(?:\.\d+)?\b", "?")
    s = F.regexp_replace(s, r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def statement_statistics(log: DataFrame, slow_ms: float = 100.0) -> DataFrame:
    """fingerprint, calls, total, least, greatest and mean ms, and slow calls of log(sql, ms)."""
    return log.groupBy(fingerprint(F.col("sql")).alias("fingerprint")).agg(
        F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms"), F.count(F.when(F.col("ms") > slow_ms, 1)).alias("slow")
    )


def generated(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Repeatable test rows (id, name, age, score) made on the executors."""
    h = F.xxhash64("id", F.lit(seed))
    return spark.range(n).select("id", F.concat(F.lit("user_"), F.col("id").cast("string")).alias("name"), (F.pmod(h, F.lit(60)) + 18).alias("age"), (F.pmod(F.shiftright(h, 8), F.lit(10000)) / 100).alias("score"))


def generated_graph(spark: SparkSession, nodes: int, degree: int, seed: int = 42) -> DataFrame:
    """Repeatable edges (src, dst): `degree` of them leave every node."""
    to = F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(nodes))
    return spark.range(nodes).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(degree)))).select(F.col("id").alias("src"), to.alias("dst"))


def _analyze_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min({c}){s} AS min_value, max({c}){s} AS max_value FROM {table}" for c, s in columns.items())


OPERATORS["analyze_table"] = Operator(lambda spark, d: analyze(load(spark, d, "nation")), _analyze_sql("nation", {"n_nationkey": "::VARCHAR", "n_name": "", "n_regionkey": "::VARCHAR"}), "2.14")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "nation", "orders")
    return information_columns(spark, "nation", "orders").select("table_name", "ordinal_position", "column_name")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir)
    return information_tables(spark).filter(F.col("table_name").isin(*TABLES)).select("table_name")


OPERATORS["information_schema_columns"] = Operator(_columns, "SELECT table_name, ordinal_position::BIGINT AS ordinal_position, column_name FROM (SELECT * FROM (VALUES ('nation', 1, 'n_nationkey'), ('nation', 2, 'n_name'), ('nation', 3, 'n_regionkey'), ('orders', 1, 'o_orderkey'), ('orders', 2, 'o_custkey'), ('orders', 3, 'o_orderstatus'), ('orders', 4, 'o_totalprice'), ('orders', 5, 'o_orderdate'), ('orders', 6, 'o_orderpriority')) v(table_name, ordinal_position, column_name))", "2.1")
OPERATORS["information_schema_tables"] = Operator(_tables, "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(table_name)", "2.1")
OPERATORS["explain_rows"] = Operator(lambda spark, d: explain(load(spark, d, "orders").filter("o_orderkey = 1")).filter("plan LIKE '%PushedFilters%'").select(F.col("plan").contains("EqualTo(o_orderkey,1)").alias("pushed")), "SELECT true AS pushed", "2.14")
OPERATORS["statement_fingerprints"] = Operator(
    lambda spark, d: statement_statistics(load(spark, d, "orders").selectExpr("concat('SELECT *  FROM t WHERE ', if(o_orderkey % 2 = 0, 'a = ', 'b IN (1, 2, 3) AND c = '), '''', o_orderkey, '''') AS sql", "CAST(o_orderkey % 200 AS DOUBLE) AS ms")).withColumn("avg_ms", F.round("avg_ms", 6)),
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'select * from t where a = ?' ELSE 'select * from t where b in (?) and c = ?' END AS fingerprint, count(*) AS calls, sum((o_orderkey % 200)::DOUBLE) AS total_ms, min((o_orderkey % 200)::DOUBLE) AS min_ms, max((o_orderkey % 200)::DOUBLE) AS max_ms, round(avg((o_orderkey % 200)::DOUBLE), 6) AS avg_ms, count(*) FILTER (WHERE o_orderkey % 200 > 100) AS slow FROM orders GROUP BY 1", "2.17")
OPERATORS["generated_rows"] = Operator(lambda spark, d: generated(spark, 1000).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), (F.min("age") >= 18).alias("grown")), "SELECT 1000::BIGINT AS n, 1000::BIGINT AS names, true AS grown", "2.1")
OPERATORS["generated_graph"] = Operator(lambda spark, d: generated_graph(spark, 100, 3).groupBy("src").agg(F.count("*").alias("n")), "SELECT range AS src, 3::BIGINT AS n FROM range(100)", "2.1")
