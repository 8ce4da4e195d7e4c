"""What the operators of this subpackage share: reading, written intermediate tables, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the complement of the word class [^\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory through Spark's own reader, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset and the master is local, a temporary folder is made and set;
    on a cluster an unset folder is an error, since no machine-local folder would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends here.

    Lost executors cost at most the tasks that read the table, not the work before it.
    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basalt/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by written() that no later step reads."""
    spark = df.sparkSession
    root = shared_dir(spark) + "/basalt/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/basalt/" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Clashes of 64-bit text hashes that a plan can name; 10 ** 11 texts have about 300.
CLASHES = 10_000


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def text_name(docs: DataFrame) -> Column:
    """A 64-bit name for docs' column text, the same for equal texts only, as far as 128 bits of hash tell; null texts have none.

    The name is a hash. One pass looks for texts that share it and differ in a second hash; these, a handful if any, are named by both.
    """
    one, two = _hashes(F.col("text"))
    pairs = docs.filter("text is not null").select(one.alias("one"), two.alias("two"))
    twice = pairs.groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).filter("low <> high")
    clashes = [r.one for r in twice.select("one").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise RuntimeError(f"more than {CLASHES} clashes of text hashes")
    name = F.when(one.isin(clashes), F.xxhash64(one, two)).otherwise(one) if clashes else one
    return F.when(F.col("text").isNotNull(), name)


#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in bad(doc_id); rows with a null id stay.

    Texts stay where they are while a count shows the ids to be few; beyond BROADCAST_IDS both sides are sorted by id, which spills.
    """
    bad = written(bad.select("doc_id"), "ids-that-go")
    few = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad.hint("merge"), "doc_id", "left_anti")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]
