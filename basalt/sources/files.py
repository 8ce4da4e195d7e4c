"""File sources and sinks: Parquet, JSON table files, pipe-delimited tables, SQL dumps, partitioned and compacted output."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

#: Type names of the DDL and the types they take here (fixed values).
TYPES = {
    "INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "INT64": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint",
    "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "STRING": "string",
    "BLOB": "binary", "BINARY": "binary", "VARBINARY": "binary", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "UUID": "string", "ENUM": "string", "JSON": "string",
}


def sql_type(name: str) -> str:
    """A Spark type for a declared type; DECIMAL(p, s) keeps its digits, unknown names are text."""
    m = re.match(r"\s*([A-Za-z]\w*)\s*(\([^)]*\))?", name)
    word = m[1].upper() if m else ""
    if word in ("DECIMAL", "NUMERIC"):
        return f"decimal{(m[2] or '(10,0)').replace(' ', '')}"
    return TYPES.get(word, "string")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = (), condition: str | None = None) -> DataFrame:
    """Column and row selection that reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.filter(condition) if condition else rows
    return rows.select(*columns) if columns else rows


def compression_for(schema: StructType) -> str:
    """lz4 for numbers, zstd for text: the codec that suits most columns of a table."""
    text = sum(f.dataType.typeName() in ("string", "binary") for f in schema.fields)
    return "zstd" if 2 * text >= len(schema.fields) else "lz4"


def write_parquet(rows: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error", codec: str | None = None) -> None:
    writer = rows.write.mode(mode).option("compression", codec or compression_for(rows.schema))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-delimited rows that end in a pipe (.tbl)."""
    return spark.read.schema(schema).option("sep", "|").option("header", False).csv(path)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A table file {name, columns: [{name, data_type, nullable}], rows: [[{"Integer": 1}, …]]} with tagged values.

    Column names and types come from the file's own header, read first.
    """
    value = "struct<Integer: bigint, Float: double, Text: string, Boolean: boolean>"
    text = f"struct<name: string, columns: array<struct<name: string, data_type: string, nullable: boolean>>, rows: array<array<{value}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", text).alias("t"))
    columns = whole.select("t.columns").first()["columns"]
    rows = whole.select(F.explode("t.rows").alias("r"))

    def cell(i: int, declared: str) -> Column:
        v = F.get("r", F.lit(i))
        return F.coalesce(v["Text"], v["Integer"].cast("string"), v["Float"].cast("string"), v["Boolean"].cast("string")).cast(sql_type(declared))

    return rows.select(*[cell(i, c["data_type"]).alias(c["name"]) for i, c in enumerate(columns)])


_CREATE = re.compile(r"CREATE TABLE\s+(?:IF NOT EXISTS\s+)?`?(\w+)`?\s*\((.*?)\)\s*(?:ENGINE[^;]*)?;", re.I | re.S)
_COLUMN = re.compile(r"^\s*`?(\w+)`?\s+([A-Za-z]+\s*(?:\([^)]*\))?)")
_INSERT = re.compile(r"^\s*INSERT INTO\s+`?(\w+)`?\s*(?:\([^)]*\))?\s*VALUES\s*(.*?);?\s*$", re.I | re.S)


def _tuples(text: str) -> Iterator[list[str | None]]:
    """The rows of a VALUES list; strings unescaped, NULL as None."""
    row: list[str | None] | None = None
    i = 0
    while i < len(text):
        c = text[i]
        if c == "(" and row is None:
            row = []
        elif c == ")" and row is not None:
            yield row
            row = None
        elif c == "'" and row is not None:
            out, i = [], i + 1
            while text[i] != "'" or text[i + 1 : i + 2] == "'":
                if text[i] == "\\":
                    i += 1
                    out.append({"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(text[i], text[i]))
                else:
                    out.append(text[i])
                    i += text[i] == "'"
                i += 1
            row.append("".join(out))
        elif row is not None and not c.isspace() and c != ",":
            end = i
            while end < len(text) and text[end] not in ",)":
                end += 1
            word = text[i:end].strip()
            row.append(None if word.upper() == "NULL" else word)
            i = end - 1
        i += 1


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a SQL dump. The schema is read from its CREATE TABLE; INSERT statements, one to a line, are parsed on the executors."""
    head = spark.read.text(path, wholetext=False).filter(~F.col("value").rlike(r"(?i)^\s*INSERT INTO")).select("value")
    schema_text = "\n".join(r.value for r in head.toLocalIterator())  # statements without their rows
    body = next((m[2] for m in _CREATE.finditer(schema_text) if m[1].lower() == table.lower()), None)
    if body is None:
        raise ValueError(f"the dump has no table {table}")
    columns = []
    for part in re.split(r",(?![^(]*\))", body):
        m = _COLUMN.match(part)
        if m and m[1].upper() not in ("PRIMARY", "UNIQUE", "KEY", "CONSTRAINT", "FOREIGN", "CHECK", "INDEX"):
            columns.append((m[1], sql_type(m[2])))

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                m = _INSERT.match(line)
                if m and m[1].lower() == table.lower():
                    rows += _tuples(m[2])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["r"])

    inserts = spark.read.text(path).filter(F.col("value").rlike(r"(?i)^\s*INSERT INTO")).mapInArrow(parse, "r array<string>")
    return inserts.select(*[F.get("r", F.lit(i)).try_cast(t).alias(c) for i, (c, t) in enumerate(columns)])


def dump_statements(rows: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, for export."""
    cells = [
        F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'")) if t == "string" else F.col(c).cast("string"))
        for c, t in rows.dtypes
    ]
    return rows.select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), F.concat_ws(", ", *cells), F.lit(");")).alias("statement"))


def partition_column(kind: str, column: str, bounds: Sequence = (), parts: int = 0) -> Column:
    """The partition number of a row under RANGE (upper bounds, exclusive), LIST (lists of values), HASH or KEY partitioning."""
    c = F.col(column)
    if kind in ("hash", "key"):
        return F.pmod(F.xxhash64(c) if kind == "key" else c.cast("bigint"), F.lit(parts)).cast("int")
    out = F.lit(len(bounds) if kind == "range" else -1)
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(c < b if kind == "range" else c.isin(*b), i).otherwise(out)
    return out


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 256 << 20) -> None:
    """OPTIMIZE: the same rows in fewer files of about target_bytes, without a shuffle."""
    from math import ceil

    rows = spark.read.parquet(path)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows.coalesce(max(1, ceil(size / target_bytes))).write.parquet(out)


OPERATORS["partition_range"] = Operator(
    lambda spark, d: load(spark, d, "customer").groupBy(partition_column("range", "c_acctbal", [0.0, 5000.0]).alias("part")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS part, count(*) AS n FROM customer GROUP BY 1", "2.14")
OPERATORS["partition_list"] = Operator(
    lambda spark, d: load(spark, d, "nation").groupBy(partition_column("list", "n_regionkey", [[0, 1], [2]]).alias("part")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN n_regionkey IN (0, 1) THEN 0 WHEN n_regionkey = 2 THEN 1 ELSE -1 END AS part, count(*) AS n FROM nation GROUP BY 1", "2.14")
OPERATORS["partition_hash"] = Operator(
    lambda spark, d: load(spark, d, "orders").groupBy(partition_column("hash", "o_custkey", parts=4).alias("part")).agg(F.count("*").alias("n")),
    "SELECT (o_custkey % 4)::INT AS part, count(*) AS n FROM orders GROUP BY 1", "2.14")
OPERATORS["dump_export"] = Operator(lambda spark, d: dump_statements(load(spark, d, "nation"), "nation"), "SELECT 'INSERT INTO `nation` VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS statement FROM nation", "2.1")
