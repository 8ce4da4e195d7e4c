"""Compliance analytics over an audit log (seq, ts, user_id, action, table_name, record_id): reports and hash-chain verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

GENESIS = "0" * 64
FIELDS = ("seq", "ts", "user_id", "action", "table_name", "record_id")


def filter_log(log: DataFrame, since=None, until=None, user=None, action=None, table=None) -> DataFrame:
    """Entries with since <= ts <= until and the given user, action and table."""
    for column, value, test in (("ts", since, "ge"), ("ts", until, "le"), ("user_id", user, "eq"), ("action", action, "eq"), ("table_name", table, "eq")):
        if value is not None:
            c = F.col(column)
            log = log.filter({"ge": c >= F.lit(value), "le": c <= F.lit(value), "eq": c == F.lit(value)}[test])
    return log


def audit_report(log: DataFrame) -> DataFrame:
    """Counts by action, user and table in one pass: dimension, name, n."""
    sets = log.groupingSets([["action"], ["user_id"], ["table_name"]], "action", "user_id", "table_name").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 3, "action").when(F.col("g") == 5, "user").otherwise("table")
    name = F.when(F.col("g") == 3, F.col("action")).when(F.col("g") == 5, F.col("user_id").cast("string")).otherwise(F.col("table_name"))
    return sets.select(dimension.alias("dimension"), name.alias("name"), "n")


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def deviations(log: DataFrame, seconds: int = 60, changes: int = 3, opens: int = 8, closes: int = 18) -> DataFrame:
    """seq, kind and severity: rapid repeated changes to a record, deletes, and changes out of hours."""
    record = Window.partitionBy("table_name", "record_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(record.orderBy("ts", "seq")).cast("timestamp"))
    rows = log.withColumn("gap", gap / 1e6).withColumn("of", F.count("*").over(record))
    rapid = rows.filter(F.col("record_id").isNotNull() & (F.col("of") > changes) & (F.col("gap") > 0) & (F.col("gap") < seconds)).select("seq", F.lit("rapid").alias("kind"), F.when(F.col("of") > 10, "HIGH").otherwise("MEDIUM").alias("severity"))
    deleted = log.filter("action = 'DELETE'").select("seq", F.lit("delete").alias("kind"), F.lit("HIGH").alias("severity"))
    hour = F.hour("ts")
    late = log.filter((hour < opens) | (hour >= closes)).select("seq", F.lit("hours").alias("kind"), F.lit("LOW").alias("severity"))
    return rapid.unionByName(deleted).unionByName(late)


def capa(found: DataFrame) -> DataFrame:
    """Corrective actions: one per kind and severity of deviation, with how many entries ask for it."""
    action = F.when(F.col("severity") == "HIGH", "investigate and correct").when(F.col("severity") == "MEDIUM", "review changes").otherwise("monitor")
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n")).withColumn("action", action)


def compliance(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, checked, failed for declarative rules (name -> SQL condition), all in one aggregation."""
    sums = [F.sum(F.when(F.coalesce(F.expr(c), F.lit(False)), 0).otherwise(1)).alias(f"f{i}") for i, c in enumerate(rules.values())]
    one = rows.agg(F.count("*").alias("checked"), *sums)
    parts = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("checked"), F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("failed")) for i, n in enumerate(rules)])
    return one.select(F.explode(parts).alias("r")).select("r.*")


def entry_hash(previous: Column) -> Column:
    """SHA-256 of an entry's fields and the hash before it."""
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]), 256)


def verify_chain(log: DataFrame, block: int = 100_000) -> DataFrame:
    """Broken entries (seq, problem) of a chained log with prev_hash and hash.

    Problems: gap (seq not one more than before), link (prev_hash is not the hash before), checksum and time (ts runs back). Every entry is
    compared with the one before it. Blocks of seq are windows of their own, each with the last entry of the block before handed
    over by its seq, so no task sorts the whole log.
    """
    part = F.floor(F.col("seq") / block)
    rows = log.withColumn("_b", part).withColumn("_own", F.lit(True))
    tails = rows.groupBy("_b").agg(F.max_by(F.struct("seq", "ts", "hash"), "seq").alias("t")).select((F.lead("_b").over(Window.orderBy("_b"))).alias("_b"), "t.*")
    handed = tails.filter("_b IS NOT NULL").withColumn("_own", F.lit(False))
    every = rows.unionByName(handed, allowMissingColumns=True)
    w = Window.partitionBy("_b").orderBy("seq")
    before = {c: F.lag(c).over(w) for c in ("seq", "ts", "hash")}
    checked = every.select("seq", "_own", "ts", "hash", "prev_hash", entry_hash(F.col("prev_hash")).alias("sum"), before["seq"].alias("ps"), before["ts"].alias("pt"), before["hash"].alias("ph")).filter("_own")
    problems = F.filter(
        F.array(
            F.when(F.col("ps").isNotNull() & (F.col("seq") != F.col("ps") + 1), F.lit("gap")),
            F.when(F.col("prev_hash") != F.coalesce("ph", F.lit(GENESIS)), F.lit("link")),
            F.when(F.col("hash") != F.col("sum"), F.lit("checksum")),
            F.when(F.col("ts") < F.col("pt"), F.lit("time")),
        ),
        lambda p: p.isNotNull(),
    )
    return checked.select("seq", F.explode(problems).alias("problem"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an audit log."""
    action = F.create_map(*[F.lit(x) for p in (("click", "UPDATE"), ("view", "SELECT"), ("error", "DELETE"), ("signup", "INSERT"), ("purchase", "UPDATE")) for x in p])
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", "user_id", action[F.col("event_type")].alias("action"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table_name"), (F.col("user_id") % 50).cast("string").alias("record_id")
    )


_LOG = """(SELECT event_id AS seq, ts, user_id, CASE event_type WHEN 'click' THEN 'UPDATE' WHEN 'view' THEN 'SELECT' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS action,
 't' || (user_id % 3) AS table_name, (user_id % 50)::VARCHAR AS record_id FROM events)"""
OPERATORS["audit_report"] = Operator(lambda spark, d: audit_report(event_log(spark, d)), f"SELECT 'action' AS dimension, action AS name, count(*) AS n FROM {_LOG} GROUP BY 2 UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM {_LOG} GROUP BY 2 UNION ALL SELECT 'table', table_name, count(*) FROM {_LOG} GROUP BY 2", "2.16")
OPERATORS["audit_recent"] = Operator(lambda spark, d: recent(event_log(spark, d)).select("seq", "action"), f"SELECT seq, action FROM {_LOG} ORDER BY ts DESC, seq DESC LIMIT 10", "2.16")
OPERATORS["audit_filter"] = Operator(lambda spark, d: filter_log(event_log(spark, d), action="DELETE", table="t1").select("seq"), f"SELECT seq FROM {_LOG} WHERE action = 'DELETE' AND table_name = 't1'", "2.16")
_DEV = f"""WITH l AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY table_name, record_id ORDER BY ts, seq))) / 1e6 AS gap, count(*) OVER (PARTITION BY table_name, record_id) AS c FROM {_LOG}),
 v AS (SELECT seq, 'rapid' AS kind, CASE WHEN c > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM l WHERE c > 3 AND gap > 0 AND gap < 60 UNION ALL SELECT seq, 'delete', 'HIGH' FROM l WHERE action = 'DELETE' UNION ALL SELECT seq, 'hours', 'LOW' FROM l WHERE hour(ts) < 8 OR hour(ts) >= 18)"""
OPERATORS["audit_deviations"] = Operator(lambda spark, d: deviations(event_log(spark, d)), f"{_DEV} SELECT * FROM v", "2.16")
OPERATORS["audit_capa"] = Operator(lambda spark, d: capa(deviations(event_log(spark, d))), f"{_DEV} SELECT kind, severity, count(*) AS n, CASE severity WHEN 'HIGH' THEN 'investigate and correct' WHEN 'MEDIUM' THEN 'review changes' ELSE 'monitor' END AS action FROM v GROUP BY kind, severity", "2.16")
OPERATORS["compliance_rules"] = Operator(
    lambda spark, d: compliance(load(spark, d, "events"), {"positive": "value >= 0", "known": "event_type IN ('click', 'view')", "dated": "ts IS NOT NULL"}),
    "SELECT 'positive' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT value >= 0) AS failed FROM events UNION ALL SELECT 'known', count(*), count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) FROM events UNION ALL SELECT 'dated', count(*), count(*) FILTER (WHERE ts IS NULL) FROM events", "2.16")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in chains of two entries (so every even entry but the first has a wrong link), with some entries gone and some hashes changed."""
    log = event_log(spark, sf_dir)
    even = log.filter("seq % 2 = 0").withColumn("prev_hash", F.lit(GENESIS))
    even = even.withColumn("hash", entry_hash(F.col("prev_hash")))
    odd = log.filter("seq % 2 = 1").join(even.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_hash")), "seq")
    odd = odd.withColumn("hash", F.when(F.col("seq") % 700 == 351, F.lit("changed")).otherwise(entry_hash(F.col("prev_hash"))))
    return verify_chain(even.unionByName(odd).filter("seq % 500 <> 499"), 1000)


OPERATORS["audit_chain"] = Operator(_chain, """WITH e AS (SELECT event_id AS seq, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events WHERE event_id % 500 <> 499)
 SELECT seq, 'gap' AS problem FROM e WHERE seq > 0 AND seq % 500 = 0 UNION ALL SELECT seq, 'link' FROM e WHERE seq > 0 AND seq % 2 = 0
 UNION ALL SELECT seq, 'checksum' FROM e WHERE seq % 700 = 351 UNION ALL SELECT seq, 'time' FROM e WHERE ts < before""", "2.16")
