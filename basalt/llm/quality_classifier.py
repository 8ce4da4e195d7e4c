"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic regression on a few counts of the text gives each document's own evidence, a log
likelihood ratio. Hosts and paths get Beta posteriors of their share of good documents: a host's is
shrunk towards the share of the whole corpus, a path's towards its host's, with strengths estimated from
how much hosts (paths) differ beyond chance, so sparse sites say little. A document's final log
odds are its path's plus its own evidence; what its host and path say of it is taken from their other documents
only, so that no evidence counts twice.

The regression is fitted on at most `max_rows` labelled rows, those of least hash(doc_id); corpus
shares and posteriors come from all documents, by grouped aggregation of narrow rows (map-side first, so a
host with a third of all documents is one row per task). The text is read once and not shuffled, also where rows are
filtered: keep_good() carries it beside the counts, and sites meet the rows by broadcast while a count shows them to be few.

Nulls, empties, ties: null texts count as empty; a null source is the host ''. A doc_id with
several labels counts as good if most are (a tie: bad). Without labels of both kinds the text gives
no evidence; of rows that share a labelled id one teaches, that of least counts. Every row gives one row and is judged by itself. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._common import written
from basalt.llm.quality_rules import features

MAX_ROWS = 20_000
THRESHOLD = 0.5
#: Sites that are broadcast at most, about 100 bytes each.
BROADCAST_SITES = 500_000
#: Evidence of one document, as log odds, lies within these bounds.
EVIDENCE = 8.0
SITE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)(?:/+([^/?#]*))?"
#: Inputs of the regression as SQL over the counts of quality_rules.features().
INPUTS = (
    "least(1D, 5D * n_symbols / (n_words + 1))",
    "n_repeat_words / (n_words + 1D)",
    "n_dup_lines / (n_lines + 1D)",
    "n_upper / (word_chars + 1D)",
    "least(1D, 2D * n_exclaim / (n_words + 1))",
    "n_digits / (word_chars + 1D)",
    "least(2D, word_chars / (n_words + 1D) / 8)",
    "20D / (20 + n_words)",
)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Coefficients of a logistic regression, the intercept first, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    b = np.zeros(x.shape[1])
    b[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-documents of a level's Beta prior, by moments; groups: n, good; centre: the mean it shrinks to."""
    mean = F.col("good") / F.col("n")
    s = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * centre * (1 - centre)).alias("chance"),
        F.sum(F.col("n") * (mean - centre) * (mean - centre)).alias("spread"),
    ).first()
    if not s["n"]:
        return 1.0
    chance = s["chance"] / s["n"]
    between = s["spread"] / s["n"] - chance * s["groups"] / s["n"]
    return min(max(chance / max(between, 1e-6) - 1, 5.0), 1e5)


def _counts(docs: DataFrame, carried: Column) -> DataFrame:
    """The regression's inputs, host and path of each row of docs(doc_id, text, source), and row, what is carried with them; a written table."""
    site = F.lower(F.coalesce("source", F.lit("")))
    label = F.struct(carried.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract(site, SITE, 1).alias("host"), F.regexp_extract(site, SITE, 2).alias("path"))
    rows = features(docs.select(label.alias("doc_id"), "text"))
    return written(rows.select("doc_id.*", *[F.expr(e).alias(f"x{i}") for i, e in enumerate(INPUTS)]), "quality-features")


def _judged(rows: DataFrame, labels: DataFrame, label: str, threshold: float, max_rows: int) -> DataFrame:
    """row, doc_id, host, path, p_doc, p_host, p_path, p_quality and kept for each of _counts()."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("y"))
    # At most max_rows rows of two numbers.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    names = [f"x{i}" for i in range(len(INPUTS))]
    taught = rows.select("doc_id", *names).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *names)).alias("s"))
    taught = taught.select("s.*").toPandas()
    y = taught["y"].to_numpy(dtype=float)
    own, p_doc = F.lit(0.0), F.lit(0.5)
    if 0 < y.sum() < len(y):
        b = fit(taught[names].to_numpy(dtype=float), y)
        line = F.lit(float(b[0]))
        for name, w in zip(names, b[1:], strict=True):
            line = line + F.lit(float(w)) * F.col(name)
        base = math.log(y.sum() / (len(y) - y.sum()))
        own = F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), line - base))
        p_doc = 1 / (1 + F.exp(-(own + base)))
    scored = rows.select("row", "doc_id", "host", "path", own.alias("own"), p_doc.alias("p_doc"))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host"))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count("*").alias("sites")).first()
    share = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    of_hosts = _strength(hosts.select(F.col("n_host").alias("n"), F.col("good_host").alias("good")), F.lit(share))
    shrunk = lambda good, n, strength, centre: (good + strength * centre) / (n + strength)
    sites = written(paths.join(hosts, "host"), "sites")
    of_paths = _strength(sites.withColumn("centre", shrunk(F.col("good_host"), F.col("n_host"), of_hosts, share)), F.col("centre"))
    few = whole["sites"] <= BROADCAST_SITES
    final = scored.join(F.broadcast(sites) if few else sites.hint("merge"), ["host", "path"])
    # A site's posterior for a document leaves the document out.
    p_host = shrunk(F.col("good_host") - F.col("p_doc"), F.col("n_host") - 1, of_hosts, share)
    final = final.withColumn("p_host", p_host).withColumn("p_path", shrunk(F.col("good") - F.col("p_doc"), F.col("n") - 1, of_paths, F.col("p_host")))
    odds = _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_path")))) + F.col("own")
    return final.withColumn("p_quality", 1 / (1 + F.exp(-odds))).select(
        "row", "doc_id", "host", "path", "p_doc", "p_host", "p_path", "p_quality", (F.col("p_quality") >= threshold).alias("kept")
    )


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, p_quality and kept for each row of docs(doc_id, text, source)."""
    return _judged(_counts(docs, F.lit(0)), labels, label, threshold, max_rows).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that are kept, each judged by itself."""
    rows = _counts(docs, F.struct(*[F.col(c) for c in docs.columns]))
    return _judged(rows, labels, label, threshold, max_rows).filter("kept").select("row.*")
