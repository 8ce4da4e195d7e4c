"""Definition statements over frames: tables with keys, checks and defaults, indexes, grants, triggers, procedures, SHOW and information_schema.

A table is a frame and its definition; a statement gives a new frame and never touches files. Rows that break a constraint are refused as a whole
statement. Indexes are definitions only (Parquet min/max and sorting on write do their work); a unique one is checked. Procedures run as Spark SQL scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.dialect import translate
from basalt.operators.dml import delete, update
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

#: Type names that Spark does not know, and what stands for them (fixed values).
TYPES = {"integer": "int", "text": "string", "varchar": "string", "char": "string", "real": "double", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "bool": "boolean", "blob": "binary", "json": "string"}


def spark_type(name: str) -> str:
    base, rest = re.match(r"\s*(\w+)\s*(\(.*\))?", name).groups()
    known = TYPES.get(base.lower())
    return known or base.lower() + (rest or "" if base.lower() in ("decimal", "numeric") else "")


def split_list(text: str) -> list[str]:
    """The parts of a list, cut at commas outside parentheses and strings."""
    parts, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def _names(text: str) -> tuple[str, ...]:
    return tuple(n.strip(" `\"").lower() for n in text.split(","))


@dataclass
class Table:
    frame: DataFrame
    primary: tuple[str, ...] = ()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    required: set[str] = field(default_factory=set)
    indexes: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)


@dataclass(frozen=True)
class Trigger:
    name: str
    moment: str
    event: str
    table: str
    body: str


class ConstraintError(ValueError):
    """A statement's rows break a constraint."""


class Catalog:
    """Tables, views, grants, triggers and procedures of one session, changed by execute()."""

    def __init__(self, spark: SparkSession, **tables: DataFrame) -> None:
        self.spark = spark
        self.tables = {n.lower(): Table(f) for n, f in tables.items()}
        self.views: dict[str, str] = {}
        self.triggers: dict[str, Trigger] = {}
        self.procedures: dict[str, tuple[list[tuple[str, str, str]], str]] = {}
        self.grants: set[tuple[str, str, str]] = set()

    def execute(self, sql: str) -> DataFrame | None:
        """One statement: rows of a query, SHOW, DESCRIBE or CALL; None for the others."""
        text = sql.strip().rstrip(";").strip()
        for pattern, method in _STATEMENTS:
            if m := re.match(pattern, text, re.I | re.S):
                return method(self, *[g.strip() if g else g for g in m.groups()])
        return self.query(text)

    def query(self, sql: str) -> DataFrame:
        """A query over the catalog's tables and views."""
        for name, table in self.tables.items():
            table.frame.createOrReplaceTempView(name)
        for name, text in self.views.items():
            self.spark.sql(translate(text)).createOrReplaceTempView(name)
        return self.spark.sql(translate(sql))

    def _rows(self, schema: str, rows: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame(sorted(rows, key=repr), schema)

    # Tables.

    def create_table(self, maybe: str | None, name: str, body: str) -> None:
        name = name.lower()
        if name in self.tables:
            if maybe:
                return
            raise ValueError(f"table {name} exists")
        table, columns = Table(None), []
        for part in split_list(body):
            if m := re.match(r"(?:CONSTRAINT\s+(\w+)\s+)?PRIMARY\s+KEY\s*\((.*)\)$", part, re.I | re.S):
                table.primary = _names(m[2])
            elif m := re.match(r"(?:CONSTRAINT\s+(\w+)\s+)?UNIQUE\s*(?:KEY|INDEX)?\s*(\w+)?\s*\((.*)\)$", part, re.I | re.S):
                table.unique[m[1] or m[2] or f"{name}_uq{len(table.unique) + 1}"] = _names(m[3])
            elif m := re.match(r"(?:CONSTRAINT\s+(\w+)\s+)?FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+(\w+)\s*\((.*?)\)", part, re.I | re.S):
                table.foreign[m[1] or f"{name}_fk{len(table.foreign) + 1}"] = (_names(m[2]), m[3].lower(), _names(m[4]))
            elif m := re.match(r"(?:CONSTRAINT\s+(\w+)\s+)?CHECK\s*\((.*)\)$", part, re.I | re.S):
                table.checks[m[1] or f"{name}_ck{len(table.checks) + 1}"] = m[2]
            else:
                columns.append(self._column(name, table, part))
        table.required |= set(table.primary)
        table.frame = self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns))
        self.tables[name] = table

    def _column(self, name: str, table: Table, part: str) -> tuple[str, str]:
        column, kind, rest = re.match(r"[`\"]?(\w+)[`\"]?\s+(\w+(?:\s*\([^)]*\))?)(.*)$", part, re.I | re.S).groups()
        column = column.lower()
        if re.search(r"PRIMARY\s+KEY", rest, re.I):
            table.primary = (column,)
        elif re.search(r"\bUNIQUE\b", rest, re.I):
            table.unique[f"{name}_{column}"] = (column,)
        if re.search(r"NOT\s+NULL|PRIMARY\s+KEY", rest, re.I):
            table.required.add(column)
        if m := re.search(r"DEFAULT\s+('(?:[^']|'')*'|[\w.()+-]+)", rest, re.I):
            table.defaults[column] = m[1]
        if m := re.search(r"CHECK\s*\((.*)\)", rest, re.I | re.S):
            table.checks[f"{name}_{column}"] = m[1]
        if m := re.search(r"REFERENCES\s+(\w+)\s*\((\w+)\)", rest, re.I):
            table.foreign[f"{name}_{column}"] = ((column,), m[1].lower(), (m[2].lower(),))
        return column, spark_type(kind)

    def create_as(self, maybe: str | None, name: str, query: str) -> None:
        if name.lower() not in self.tables:
            self.tables[name.lower()] = Table(self.query(query))
        elif not maybe:
            raise ValueError(f"table {name} exists")

    def drop_table(self, maybe: str | None, name: str) -> None:
        if self.tables.pop(name.lower(), None) is None and not maybe:
            raise ValueError(f"no table {name}")

    def truncate(self, name: str) -> None:
        table = self.tables[name.lower()]
        table.frame = table.frame.limit(0)

    def add_column(self, name: str, definition: str) -> None:
        """ADD COLUMN: rows that are there get the default, or NULL."""
        table = self.tables[name.lower()]
        column, kind = self._column(name.lower(), table, definition)
        value = F.expr(table.defaults.get(column, "NULL")).cast(kind)
        table.frame = table.frame.withColumn(column, value)

    def drop_column(self, name: str, column: str) -> None:
        table = self.tables[name.lower()]
        table.frame = table.frame.drop(column.lower())
        table.defaults.pop(column.lower(), None)
        table.required.discard(column.lower())

    def modify_column(self, name: str, column: str, kind: str) -> None:
        table = self.tables[name.lower()]
        table.frame = table.frame.withColumn(column.lower(), F.col(column).try_cast(spark_type(kind)))

    def rename_column(self, name: str, old: str, new: str) -> None:
        table, old, new = self.tables[name.lower()], old.lower(), new.lower()
        swap = lambda names: tuple(new if n == old else n for n in names)
        table.frame = table.frame.withColumnRenamed(old, new)
        table.primary, table.unique = swap(table.primary), {k: swap(v) for k, v in table.unique.items()}
        table.foreign = {k: (swap(a), t, b) for k, (a, t, b) in table.foreign.items()}
        table.indexes = {k: (swap(v), u) for k, (v, u) in table.indexes.items()}
        table.required, table.defaults = set(swap(table.required)), {new if k == old else k: v for k, v in table.defaults.items()}

    def rename_table(self, name: str, new: str) -> None:
        self.tables[new.lower()] = self.tables.pop(name.lower())
        self.triggers = {k: replace(t, table=new.lower()) if t.table == name.lower() else t for k, t in self.triggers.items()}

    def create_index(self, unique: str | None, index: str, name: str, columns: str) -> None:
        table, columns = self.tables[name.lower()], _names(columns)
        if unique:
            self._refuse_repeats(table.frame, columns, index)
        table.indexes[index.lower()] = (columns, bool(unique))

    def drop_index(self, index: str, name: str | None) -> None:
        for table in [self.tables[name.lower()]] if name else self.tables.values():
            table.indexes.pop(index.lower(), None)

    def create_view(self, name: str, query: str) -> None:
        self.views[name.lower()] = query

    def drop_view(self, name: str) -> None:
        self.views.pop(name.lower(), None)

    # Rows.

    def _refuse_repeats(self, rows: DataFrame, columns: tuple[str, ...], what: str) -> None:
        known = rows.dropna(subset=list(columns))
        if not known.groupBy(*columns).count().filter("count > 1").isEmpty():
            raise ConstraintError(f"{what}: repeated key")

    def check(self, name: str, rows: DataFrame) -> None:
        """Refuse rows as a table's contents if they break one of its constraints."""
        table = self.tables[name]
        for column in sorted(table.required):
            if not rows.filter(F.col(column).isNull()).isEmpty():
                raise ConstraintError(f"{name}.{column} is NULL")
        keys = {"PRIMARY": table.primary} if table.primary else {}
        keys |= table.unique | {i: c for i, (c, unique) in table.indexes.items() if unique}
        for key, columns in keys.items():
            self._refuse_repeats(rows, columns, key)
        for key, condition in table.checks.items():
            if not rows.filter(~F.coalesce(F.expr(condition), F.lit(True))).isEmpty():
                raise ConstraintError(key)
        for key, (columns, parent, targets) in table.foreign.items():
            there = (rows if parent == name else self.tables[parent].frame).select(*[F.col(t).alias(c) for c, t in zip(columns, targets, strict=True)])
            if not rows.dropna(subset=list(columns)).join(there, list(columns), "left_anti").isEmpty():
                raise ConstraintError(key)

    def _fire(self, moment: str, event: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows (columns new and old, structs) after a table's triggers; statements of AFTER triggers add rows to other tables."""
        for t in self.triggers.values():
            if (t.moment, t.event, t.table) != (moment, event, name):
                continue
            if m := re.match(r"SET\s+(.*)$", t.body, re.I | re.S):
                for assignment in split_list(m[1]):
                    column, value = re.match(r"NEW\.(\w+)\s*=\s*(.*)$", assignment, re.I | re.S).groups()
                    rows = rows.withColumn("new", F.col("new").withField(column.lower(), F.expr(value)))
            elif m := re.match(r"INSERT\s+INTO\s+(\w+)\s*\((.*?)\)\s*VALUES\s*\((.*)\)$", t.body, re.I | re.S):
                made = rows.select(*[F.expr(v).alias(c) for c, v in zip(_names(m[2]), split_list(m[3]), strict=True)])
                self.append(m[1].lower(), made)
            else:
                raise ValueError(f"trigger body not understood: {t.body}")
        return rows

    def append(self, name: str, rows: DataFrame) -> None:
        """INSERT rows: columns that they lack get their defaults."""
        table = self.tables[name]
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.expr(table.defaults.get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in table.frame.schema.fields])
        fired = self._fire("before", "insert", name, full.select(F.struct("*").alias("new")))
        fresh = fired.select("new.*")
        every = table.frame.unionByName(fresh)
        self.check(name, every)
        table.frame = every
        self._fire("after", "insert", name, fired)

    def insert(self, name: str, columns: str | None, source: str) -> None:
        rows = self.query(source if re.match(r"SELECT|WITH", source, re.I) else f"SELECT * FROM {source}")
        names = _names(columns) if columns else self.tables[name.lower()].frame.columns
        self.append(name.lower(), rows.toDF(*names))

    def delete(self, name: str, condition: str | None) -> None:
        table, condition = self.tables[name.lower()], condition or "true"
        gone = table.frame.filter(F.expr(condition)).select(F.struct("*").alias("old"))
        self._fire("before", "delete", name.lower(), gone)
        table.frame = delete(table.frame, condition)
        self._fire("after", "delete", name.lower(), gone)

    def update(self, name: str, assignments: str, condition: str | None) -> None:
        table, condition = self.tables[name.lower()], condition or "true"
        pairs = dict(re.match(r"(\w+)\s*=\s*(.*)$", a, re.S).groups() for a in split_list(assignments))
        columns = table.frame.columns
        hit = table.frame.filter(F.expr(condition))
        after = hit.select(F.struct(*columns).alias("old"), F.struct(*[F.expr(pairs.get(c, c)).cast(table.frame.schema[c].dataType).alias(c) for c in columns]).alias("new"))
        fired = self._fire("before", "update", name.lower(), after)
        rest = update(table.frame, {}, condition).filter(~F.coalesce(F.expr(condition), F.lit(False)))
        every = rest.unionByName(fired.select("new.*"))
        self.check(name.lower(), every)
        table.frame = every
        self._fire("after", "update", name.lower(), fired)

    # Triggers, procedures and grants.

    def create_trigger(self, name: str, moment: str, event: str, table: str, body: str) -> None:
        self.triggers[name.lower()] = Trigger(name.lower(), moment.lower(), event.lower(), table.lower(), body)

    def drop_trigger(self, name: str) -> None:
        self.triggers.pop(name.lower(), None)

    def create_procedure(self, name: str, parameters: str, body: str) -> None:
        """Parameters are [IN|OUT|INOUT] name type; the body is BEGIN … END."""
        found = [re.match(r"(?:(IN|OUT|INOUT)\s+)?(\w+)\s+(.+)$", p, re.I | re.S).groups() for p in split_list(parameters)]
        self.procedures[name.lower()] = ([((mode or "IN").upper(), n, spark_type(t)) for mode, n, t in found], body)

    def drop_procedure(self, name: str) -> None:
        self.procedures.pop(name.lower(), None)

    def call(self, name: str, arguments: str) -> DataFrame:
        """CALL: the result of the procedure's last query; with OUT parameters, a row of their values."""
        parameters, body = self.procedures[name.lower()]
        values = split_list(arguments)
        given = "\n".join(f"DECLARE {n} {t} DEFAULT {values[i] if mode != 'OUT' else 'NULL'};" for i, (mode, n, t) in enumerate(parameters))
        out = [n for mode, n, _ in parameters if mode != "IN"]
        result = f"SELECT {', '.join(out)};" if out else ""
        for table, t in self.tables.items():
            t.frame.createOrReplaceTempView(table)
        self.spark.conf.set("spark.sql.scripting.enabled", "true")
        inner = re.match(r"BEGIN(.*)END$", body, re.I | re.S)[1]
        return self.spark.sql(f"BEGIN\n{given}\n{inner}\n{result}\nEND")

    def grant(self, privileges: str, table: str, to: str) -> None:
        self.grants |= {(u, table.lower(), p.upper()) for u in _names(to) for p in _names(privileges)}

    def revoke(self, privileges: str, table: str, of: str) -> None:
        self.grants -= {(u, table.lower(), p.upper()) for u in _names(of) for p in _names(privileges)}

    # SHOW, DESCRIBE and information_schema.

    def show_tables(self) -> DataFrame:
        return self._rows("table_name string", [(n,) for n in (*self.tables, *self.views)])

    def show_databases(self) -> DataFrame:
        return self._rows("database string", [(d.name,) for d in self.spark.catalog.listDatabases()])

    def describe(self, name: str) -> DataFrame:
        """field, type, null, key (PRI, UNI, MUL or empty) and default of a table's columns, in order."""
        t = self.tables[name.lower()]
        key = {c: "MUL" for columns, _ in t.indexes.values() for c in columns[:1]} | {c: "MUL" for columns, *_ in t.foreign.values() for c in columns[:1]}
        key |= {columns[0]: "UNI" for columns in t.unique.values() if len(columns) == 1} | dict.fromkeys(t.primary, "PRI")
        rows = [(f.name, f.dataType.simpleString(), "NO" if f.name in t.required else "YES", key.get(f.name, ""), t.defaults.get(f.name)) for f in t.frame.schema.fields]
        return self.spark.createDataFrame(rows, "field string, type string, null string, key string, `default` string")

    def show_index(self, name: str) -> DataFrame:
        return self.information("statistics").filter(F.col("table_name") == name.lower())

    def show_status(self) -> DataFrame:
        return self._rows("name string, rows bigint", [(n, t.frame.count()) for n, t in self.tables.items()])

    def show_variables(self, like: str | None) -> DataFrame:
        rows = self.spark.sql("SET").select(F.col("key").alias("variable_name"), "value")
        return rows.filter(F.col("variable_name").like(like.strip("'"))) if like else rows

    def show_grants(self, user: str | None) -> DataFrame:
        rows = self.information("table_privileges")
        return rows.filter(F.col("grantee") == user.strip("'\"`").lower()) if user else rows

    def show_triggers(self) -> DataFrame:
        return self.information("triggers")

    def show_procedures(self) -> DataFrame:
        return self.information("routines")

    def information(self, view: str) -> DataFrame:
        """A view of information_schema."""
        keyed = {n: ({"PRIMARY": t.primary} if t.primary else {}) | t.unique for n, t in self.tables.items()}
        kind = lambda k: "PRIMARY KEY" if k == "PRIMARY" else "UNIQUE"
        made = {
            "schemata": lambda: ("schema_name string", [(d.name,) for d in self.spark.catalog.listDatabases()]),
            "tables": lambda: ("table_name string, table_type string", [(n, "BASE TABLE") for n in self.tables] + [(n, "VIEW") for n in self.views]),
            "columns": lambda: (
                "table_name string, ordinal_position int, column_name string, data_type string, is_nullable string, column_default string",
                [(n, i, f.name, f.dataType.simpleString(), "NO" if f.name in t.required else "YES", t.defaults.get(f.name)) for n, t in self.tables.items() for i, f in enumerate(t.frame.schema.fields, 1)],
            ),
            "statistics": lambda: (
                "table_name string, index_name string, seq_in_index int, column_name string, non_unique int",
                [(n, k, i, c, 0) for n, keys in keyed.items() for k, cs in keys.items() for i, c in enumerate(cs, 1)]
                + [(n, k, i, c, int(not u)) for n, t in self.tables.items() for k, (cs, u) in t.indexes.items() for i, c in enumerate(cs, 1)],
            ),
            "table_constraints": lambda: (
                "table_name string, constraint_name string, constraint_type string",
                [(n, k, kind(k)) for n, keys in keyed.items() for k in keys] + [(n, k, "FOREIGN KEY") for n, t in self.tables.items() for k in t.foreign] + [(n, k, "CHECK") for n, t in self.tables.items() for k in t.checks],
            ),
            "key_column_usage": lambda: (
                "table_name string, constraint_name string, ordinal_position int, column_name string, referenced_table string, referenced_column string",
                [(n, k, i, c, None, None) for n, keys in keyed.items() for k, cs in keys.items() for i, c in enumerate(cs, 1)]
                + [(n, k, i, c, p, r) for n, t in self.tables.items() for k, (cs, p, rs) in t.foreign.items() for i, (c, r) in enumerate(zip(cs, rs, strict=True), 1)],
            ),
            "referential_constraints": lambda: ("table_name string, constraint_name string, referenced_table string", [(n, k, p) for n, t in self.tables.items() for k, (_, p, _) in t.foreign.items()]),
            "check_constraints": lambda: ("table_name string, constraint_name string, check_clause string", [(n, k, c) for n, t in self.tables.items() for k, c in t.checks.items()]),
            "views": lambda: ("table_name string, view_definition string", list(self.views.items())),
            "triggers": lambda: ("trigger_name string, action_timing string, event string, table_name string, action string", [(t.name, t.moment.upper(), t.event.upper(), t.table, t.body) for t in self.triggers.values()]),
            "routines": lambda: ("routine_name string, routine_type string", [(n, "PROCEDURE") for n in self.procedures]),
            "parameters": lambda: ("routine_name string, ordinal_position int, mode string, parameter_name string, data_type string", [(r, i, *p) for r, (ps, _) in self.procedures.items() for i, p in enumerate(ps, 1)]),
            "table_privileges": lambda: ("grantee string, table_name string, privilege string", self.grants),
            "character_sets": lambda: ("character_set_name string, max_bytes int", [("utf8mb4", 4)]),
            "collations": lambda: ("collation_name string, character_set_name string", [("utf8mb4_bin", "utf8mb4")]),
        }
        return self._rows(*made[view.lower()]())


_NAME = r"[`\"]?(\w+)[`\"]?"
#: Statements by their shapes; groups are the arguments of the method.
_STATEMENTS = (
    (rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+AS\s+(.*)$", Catalog.create_as),
    (rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\((.*)\)$", Catalog.create_table),
    (rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{_NAME}$", Catalog.drop_table),
    (rf"TRUNCATE\s+(?:TABLE\s+)?{_NAME}$", Catalog.truncate),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+ADD\s+(?:COLUMN\s+)?(.*)$", Catalog.add_column),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+DROP\s+(?:COLUMN\s+)?{_NAME}$", Catalog.drop_column),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+MODIFY\s+(?:COLUMN\s+)?{_NAME}\s+(.*)$", Catalog.modify_column),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+RENAME\s+COLUMN\s+{_NAME}\s+TO\s+{_NAME}$", Catalog.rename_column),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+RENAME\s+(?:TO\s+)?{_NAME}$", Catalog.rename_table),
    (rf"CREATE\s+(UNIQUE\s+)?INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\((.*)\)$", Catalog.create_index),
    (rf"DROP\s+INDEX\s+{_NAME}(?:\s+ON\s+{_NAME})?$", Catalog.drop_index),
    (rf"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+{_NAME}\s+AS\s+(.*)$", Catalog.create_view),
    (rf"DROP\s+VIEW\s+{_NAME}$", Catalog.drop_view),
    (rf"INSERT\s+INTO\s+{_NAME}\s*(?:\((.*?)\))?\s*((?:VALUES|SELECT|WITH)\b.*)$", Catalog.insert),
    (rf"DELETE\s+FROM\s+{_NAME}(?:\s+WHERE\s+(.*))?$", Catalog.delete),
    (rf"UPDATE\s+{_NAME}\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", Catalog.update),
    (rf"CREATE\s+TRIGGER\s+{_NAME}\s+(BEFORE|AFTER)\s+(INSERT|UPDATE|DELETE)\s+ON\s+{_NAME}\s+FOR\s+EACH\s+ROW\s+(.*)$", Catalog.create_trigger),
    (rf"DROP\s+TRIGGER\s+{_NAME}$", Catalog.drop_trigger),
    (rf"CREATE\s+PROCEDURE\s+{_NAME}\s*\((.*?)\)\s*(BEGIN\b.*END)$", Catalog.create_procedure),
    (rf"DROP\s+PROCEDURE\s+{_NAME}$", Catalog.drop_procedure),
    (rf"CALL\s+{_NAME}\s*\((.*)\)$", Catalog.call),
    (rf"GRANT\s+(.*?)\s+ON\s+{_NAME}\s+TO\s+(.*)$", Catalog.grant),
    (rf"REVOKE\s+(.*?)\s+ON\s+{_NAME}\s+FROM\s+(.*)$", Catalog.revoke),
    (r"SHOW\s+TABLES$", Catalog.show_tables),
    (r"SHOW\s+(?:DATABASES|SCHEMAS)$", Catalog.show_databases),
    (rf"(?:SHOW\s+COLUMNS\s+FROM|DESCRIBE|DESC)\s+{_NAME}$", Catalog.describe),
    (rf"SHOW\s+(?:INDEX|INDEXES|KEYS)\s+FROM\s+{_NAME}$", Catalog.show_index),
    (r"SHOW\s+TABLE\s+STATUS$", Catalog.show_status),
    (r"SHOW\s+VARIABLES(?:\s+LIKE\s+(.*))?$", Catalog.show_variables),
    (r"SHOW\s+GRANTS(?:\s+FOR\s+(.*))?$", Catalog.show_grants),
    (r"SHOW\s+TRIGGERS$", Catalog.show_triggers),
    (r"SHOW\s+PROCEDURE\s+STATUS$", Catalog.show_procedures),
    (rf"SELECT\s+\*\s+FROM\s+information_schema\.{_NAME}$", Catalog.information),
)


def _shop(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog over orders and customers, with a table of its own made by statements."""
    c = Catalog(spark, orders=load(spark, sf_dir, "orders"), customer=load(spark, sf_dir, "customer"))
    for statement in (
        "CREATE TABLE bill (id BIGINT PRIMARY KEY, cust BIGINT NOT NULL REFERENCES customer (c_custkey), total DOUBLE DEFAULT 0, note VARCHAR(20) DEFAULT 'new', CONSTRAINT positive CHECK (total >= 0))",
        "CREATE TABLE bill_log (id BIGINT, what TEXT)",
        "CREATE INDEX by_cust ON bill (cust)",
        "CREATE TRIGGER round_up BEFORE INSERT ON bill FOR EACH ROW SET NEW.total = ceil(NEW.total)",
        "CREATE TRIGGER log_gone AFTER DELETE ON bill FOR EACH ROW INSERT INTO bill_log (id, what) VALUES (OLD.id, 'gone')",
        "CREATE VIEW dear AS SELECT id FROM bill WHERE total > 1000",
        "CREATE PROCEDURE steps (IN n INT, OUT total BIGINT) BEGIN DECLARE i INT DEFAULT 0; SET total = 0; WHILE i < n DO SET i = i + 1; IF i % 2 = 0 THEN SET total = total + i; END IF; END WHILE; END",
        "GRANT SELECT, INSERT ON bill TO ann",
        "REVOKE INSERT ON bill FROM ann",
    ):
        c.execute(statement)
    return c


def _altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _shop(spark, sf_dir)
    for statement in (
        "INSERT INTO bill (id, cust, total) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
        "ALTER TABLE bill ADD COLUMN paid INT DEFAULT 0",
        "UPDATE bill SET paid = 1, note = 'old' WHERE id % 3 = 0",
        "DELETE FROM bill WHERE id % 10 = 7",
        "ALTER TABLE bill RENAME COLUMN total TO amount",
        "ALTER TABLE bill MODIFY COLUMN amount BIGINT",
        "ALTER TABLE bill DROP COLUMN cust",
        "ALTER TABLE bill RENAME TO bills",
    ):
        c.execute(statement)
    return c.execute("SELECT id, amount, note, paid, 'kept' AS what FROM bills UNION ALL SELECT id, NULL, NULL, NULL, what FROM bill_log")


OPERATORS["ddl_statements"] = Operator(
    _altered,
    """SELECT o_orderkey AS id, ceil(o_totalprice)::BIGINT AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS paid, 'kept' AS what FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 7
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'gone' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 7""",
    "2.14",
)
OPERATORS["ddl_create_as_truncate"] = Operator(
    lambda spark, d: (c := _shop(spark, d), c.execute("CREATE TABLE copy AS SELECT o_orderkey FROM orders"), c.execute("CREATE TABLE other AS SELECT * FROM copy"), c.execute("TRUNCATE TABLE copy"))[0].execute("SHOW TABLE STATUS").filter("name IN ('copy', 'other', 'bill')"),
    "SELECT 'copy' AS name, 0 AS rows UNION ALL SELECT 'bill', 0 UNION ALL SELECT 'other', count(*) FROM orders",
    "2.14",
)
OPERATORS["procedure_call"] = Operator(
    lambda spark, d: _shop(spark, d).execute("CALL steps(10, @t)"), "SELECT sum(range)::BIGINT AS total FROM range(11) WHERE range % 2 = 0", "2.13"
)
OPERATORS["show_describe"] = Operator(
    lambda spark, d: _shop(spark, d).execute("DESCRIBE bill"),
    """SELECT * FROM (VALUES ('id', 'bigint', 'NO', 'PRI', NULL), ('cust', 'bigint', 'NO', 'MUL', NULL), ('total', 'double', 'YES', '', '0'), ('note', 'string', 'YES', '', '''new''')) v(field, type, "null", key, "default")""",
    "2.14",
)
OPERATORS["show_tables"] = Operator(lambda spark, d: _shop(spark, d).execute("SHOW TABLES"), "SELECT unnest(['bill', 'bill_log', 'customer', 'dear', 'orders']) AS table_name", "2.14")
OPERATORS["show_grants"] = Operator(lambda spark, d: _shop(spark, d).execute("SHOW GRANTS FOR 'ann'"), "SELECT 'ann' AS grantee, 'bill' AS table_name, 'SELECT' AS privilege", "2.14")
OPERATORS["information_schema_constraints"] = Operator(
    lambda spark, d: _shop(spark, d).execute("SELECT * FROM information_schema.table_constraints"),
    "SELECT * FROM (VALUES ('bill', 'PRIMARY', 'PRIMARY KEY'), ('bill', 'bill_cust', 'FOREIGN KEY'), ('bill', 'positive', 'CHECK')) v(table_name, constraint_name, constraint_type)",
    "2.1",
)
OPERATORS["information_schema_key_usage"] = Operator(
    lambda spark, d: _shop(spark, d).execute("SELECT * FROM information_schema.key_column_usage"),
    "SELECT * FROM (VALUES ('bill', 'PRIMARY', 1, 'id', NULL, NULL), ('bill', 'bill_cust', 1, 'cust', 'customer', 'c_custkey')) v(table_name, constraint_name, ordinal_position, column_name, referenced_table, referenced_column)",
    "2.1",
)
OPERATORS["information_schema_triggers"] = Operator(
    lambda spark, d: _shop(spark, d).execute("SHOW TRIGGERS").select("trigger_name", "action_timing", "event", "table_name"),
    "SELECT * FROM (VALUES ('round_up', 'BEFORE', 'INSERT', 'bill'), ('log_gone', 'AFTER', 'DELETE', 'bill')) v(trigger_name, action_timing, event, table_name)",
    "2.13",
)
OPERATORS["information_schema_routines"] = Operator(
    lambda spark, d: (c := _shop(spark, d)).information("routines").crossJoin(c.information("parameters").drop("routine_name")),  # two rows of a definition
    "SELECT 'steps' AS routine_name, 'PROCEDURE' AS routine_type, unnest([1, 2]) AS ordinal_position, unnest(['IN', 'OUT']) AS mode, unnest(['n', 'total']) AS parameter_name, unnest(['int', 'bigint']) AS data_type",
    "2.1",
)
