"""Session construction and table access shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def build_session(master: str = "local[*]", app: str = "basalt", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, ANSI, AQE and Arrow.

    Cluster deployments normally bring their own session; nothing here is required
    beyond ``spark.sql.session.timeZone=UTC``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, whatever file system the directory is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for the SQL entry points; all tables when no name is given."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
