"""Tokenizers, inverted-index search and fuzzy search, as expressions and grouped aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.vector import cosine_similarity, norm
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load

#: The 48 stop words.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could "
    "should may might must shall can this that these those it its as if"
).split()

CJK = "[\\x{4e00}-\\x{9fff}]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of more than one byte that are not stop words, in order."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(STOP_WORDS))


def cjk_tokens(text: Column) -> Column:
    """ASCII words, and single and paired characters of each run of CJK ideographs."""
    ascii_words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    runs = F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0))

    def grams(run: Column) -> Column:
        singles = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))
        return F.concat(singles, F.coalesce(pairs, F.array().cast("array<string>")))

    return F.concat(ascii_words, F.flatten(F.transform(runs, grams)))


def all_tokens(text: Column) -> Column:
    """Both tokenizers' tokens, distinct and sorted."""
    return F.array_sort(F.array_union(tokens(text), cjk_tokens(text)))


def inverted_index(docs: DataFrame) -> DataFrame:
    """Postings (token, doc_id, tf) of docs(doc_id, text); partition or bucket it by token to serve searches."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def search_texts(docs: DataFrame, query: str) -> DataFrame:
    """search() without an index: the rows of docs(doc_id, text) that hold every query token, judged within the scan.

    Only texts that hold the tokens as substrings are cut into words.
    """
    wanted = F.array_distinct(tokens(F.lit(query)))
    lower = F.lower("text")
    found = F.size(F.array_intersect(F.filter(F.split(lower, "[^\\p{L}\\p{N}_]+"), lambda w: F.array_contains(wanted, w)), wanted))
    return docs.filter(F.size(wanted) > 0).filter(F.forall(wanted, lambda w: F.contains(lower, w))).filter(found == F.size(wanted)).select("doc_id")


def search(index: DataFrame, query: str) -> DataFrame:
    """doc_id of documents that hold every query token; none if a token occurs nowhere."""
    wanted = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token"))
    n = F.size(F.array_distinct(tokens(F.lit(query))))
    hits = index.join(F.broadcast(wanted), "token").groupBy("doc_id").agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") == n).select("doc_id")


def fuzzy_search(index: DataFrame, query: str, distance: int = 1) -> DataFrame:
    """doc_id and hits: pairs of a query token and a document's token within an edit distance, most hits first.

    The vocabulary is matched first, so each distinct token is compared once, whatever its postings.
    """
    wanted = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("q"))
    vocabulary = index.select("token").distinct()
    near = vocabulary.crossJoin(F.broadcast(wanted)).filter(F.levenshtein("token", "q", distance) >= 0).select("token", "q")  # a query's few tokens
    return index.join(near, "token").groupBy("doc_id").agg(F.count("*").alias("hits"))


def like_query(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.filter(F.col("text").like(pattern)).select("doc_id")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source")


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: octet_length(encode(w)) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], w))"
OPERATORS["text_tokens"] = Operator(
    lambda spark, d: _docs(spark, d).select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n"), F.md5(F.array_join(tokens(F.col("text")), " ")).alias("h")),
    f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)", "2.10")
OPERATORS["text_cjk_tokens"] = Operator(
    lambda spark, d: _docs(spark, d).select("doc_id", F.md5(F.array_join(all_tokens(F.concat("text", F.lit(" 数据库系统"))), " ")).alias("h")),
    f"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_concat({_TOKENS}, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1), ['数据库系统', '数', '据', '库', '系', '统', '数据', '据库', '库系', '系统']))), ' ')) AS h FROM documents", "2.10")
OPERATORS["text_inverted_index"] = Operator(
    lambda spark, d: inverted_index(_docs(spark, d)).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"), F.sum(F.col("doc_id") * F.col("tf")).alias("digest")),
    f"SELECT token, count(DISTINCT doc_id) AS docs, count(*)::BIGINT AS tf, sum(doc_id)::BIGINT AS digest FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token", "2.10")
OPERATORS["text_search"] = Operator(
    lambda spark, d: search_texts(_docs(spark, d), "License released under"),
    f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'license') AND list_contains(t, 'released') AND list_contains(t, 'under')", "2.10")
OPERATORS["text_fuzzy_search"] = Operator(
    lambda spark, d: fuzzy_search(inverted_index(_docs(spark, d)), "licence unter", 1),
    f"SELECT doc_id, count(*) AS hits FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM documents), (VALUES ('licence'), ('unter')) q(q) WHERE levenshtein(token, q) <= 1 GROUP BY doc_id", "2.10")
OPERATORS["text_like"] = Operator(lambda spark, d: like_query(_docs(spark, d), "%MIT License%"), "SELECT doc_id FROM documents WHERE text LIKE '%MIT License%'", "2.10")
OPERATORS["text_by_source"] = Operator(
    lambda spark, d: _docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.max(F.length("text")).cast("bigint").alias("longest")),
    "SELECT source, count(*) AS docs, max(length(text))::BIGINT AS longest FROM documents GROUP BY source", "2.10")


def hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """A repeatable embedding: every token adds or takes one at the place of its hash, and the sum is brought to length one (zeros stay)."""
    return embed_tokens(tokens(F.coalesce(text, F.lit(""))), dimensions)


def embed_tokens(words: Column, dimensions: int = 64) -> Column:
    """hash_embedding() of a text's tokens: they are hashed where they are cut, and their places are added up in one pass by an Arrow-batched function."""

    @F.arrow_udf("array<double>")
    def summed(places: pa.Array) -> pa.Array:
        codes, rows = places.flatten().to_numpy(zero_copy_only=False), len(places)
        row = np.repeat(np.arange(rows), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        raw = np.bincount(row * dimensions + codes // 2, codes % 2 * 2.0 - 1, rows * dimensions).reshape(rows, dimensions)
        length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype="int32") * dimensions, (raw / np.where(length > 0, length, 1)).ravel())

    return summed(F.transform(words, lambda w: 2 * F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int") + F.getbit(F.xxhash64(w, F.lit(1)), F.lit(0))))


def text_score(text: Column, query: str) -> Column:
    """The share of a query's distinct tokens that a text holds."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens(text), wanted)), F.size(wanted)), F.lit(0.0))


def document_search(docs: DataFrame, vectors: DataFrame, query: str, q: list[float], k: int = 10, shares: tuple[float, float] = (0.6, 0.4), status: str | None = None) -> DataFrame:
    """id and score, the weighted sum of a document's vector similarity and its text score, best first; only documents of a status, if given."""
    rows = docs.filter(F.col("status") == status) if status else docs
    near = vectors.select("id", cosine_similarity(F.col("v"), F.lit([float(x) for x in q])).alias("near"))
    scored = rows.join(near, "id").select("id", (shares[0] * F.col("near") + shares[1] * text_score(F.col("text"), query)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def rerank(first: DataFrame, vector: DataFrame, graph: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), k: int = 10) -> DataFrame:
    """id and score: the weighted sum of three (id, score) frames over the ids of the first; a missing score is zero."""
    both = first.select("id", F.col("score").alias("a")).join(vector.select("id", F.col("score").alias("b")), "id", "left").join(graph.select("id", F.col("score").alias("c")), "id", "left")
    total = sum((w * F.coalesce(c, F.lit(0.0)) for w, c in zip(weights, ("a", "b", "c"), strict=True)), F.lit(0.0))
    return both.select("id", total.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_memory(entries: DataFrame, query: str, k: int = 10) -> DataFrame:
    """id and score of entries(id, text, importance): token overlap with the query times importance, entries without overlap left out."""
    score = text_score(F.col("text"), query) * F.col("importance")
    return entries.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def find_documents(docs: DataFrame, doc_type: str | None = None, status: str | None = None, effective: str | None = None, keyword: str | None = None) -> DataFrame:
    """Rows of docs(id, doc_type, status, effective_from, effective_to, text) by what is asked; a date that is NULL is no bound."""
    rows = docs
    if doc_type is not None:
        rows = rows.filter(F.col("doc_type") == doc_type)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if effective is not None:
        day = F.to_date(F.lit(effective))
        rows = rows.filter((F.coalesce("effective_from", day) <= day) & (F.coalesce("effective_to", day) >= day))
    return rows.filter(F.lower("text").contains(keyword.lower())) if keyword is not None else rows


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a type, a status and dates that follow from their columns."""
    return load(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "lang AS doc_type", "if(doc_id % 3 = 0, 'ACTIVE', 'DRAFT') AS status", "text",
        "if(doc_id % 5 = 0, NULL, date_add(DATE '2024-01-01', CAST(doc_id % 100 AS INT))) AS effective_from", "if(doc_id % 7 = 0, NULL, DATE '2024-03-01') AS effective_to",
    )


_SCORE = f"len(list_intersect({_TOKENS}, ['license', 'released', 'under'])) / 3.0::DOUBLE"
OPERATORS["text_hash_embedding"] = Operator(
    lambda spark, d: _docs(spark, d).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").alias("n"), embed_tokens(F.col("t")).alias("v")).select("doc_id", F.size("v").alias("size"), F.when(F.col("n") == 0, norm(F.col("v")) == 0).otherwise(F.round(norm(F.col("v")), 6).isin(0.0, 1.0)).alias("unit")),
    "SELECT doc_id, 64 AS size, true AS unit FROM documents", "2.10")
OPERATORS["document_hybrid_search"] = Operator(
    lambda spark, d: document_search(_managed(spark, d), load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "License released under", list(load(spark, d, "embeddings").filter("vec_id = 0").first().embedding), 20, status="ACTIVE").select("id", F.round("score", 6).alias("score")),
    f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0),
 s AS (SELECT doc_id AS id, 0.6 * list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) + 0.4 * coalesce({_SCORE}, 0) AS score FROM documents JOIN e ON doc_id = id, q WHERE doc_id % 3 = 0)
 SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20""", "2.10")
OPERATORS["document_queries"] = Operator(
    lambda spark, d: find_documents(_managed(spark, d), "en", "ACTIVE", "2024-02-01", "license").select("id"),
    "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 AND (doc_id % 5 = 0 OR DATE '2024-01-01' + (doc_id % 100)::INT <= DATE '2024-02-01') AND contains(lower(text), 'license')", "2.17")
OPERATORS["memory_search"] = Operator(
    lambda spark, d: search_memory(load(spark, d, "documents").selectExpr("doc_id AS id", "text", "1 / (1D + doc_id % 10) AS importance"), "License released under", 15).select("id", F.round("score", 6).alias("score")),
    f"SELECT id, round(score, 6) AS score FROM (SELECT doc_id AS id, {_SCORE} * (1 / (1 + doc_id % 10)::DOUBLE) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 15", "2.17")
OPERATORS["document_rerank"] = Operator(
    lambda spark, d: rerank(
        search_memory(load(spark, d, "documents").selectExpr("doc_id AS id", "text", "1D AS importance"), "License released under", 1000),
        load(spark, d, "embeddings").selectExpr("vec_id AS id", "CAST(label AS DOUBLE) / 10 AS score"), load(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "1D AS score"), k=25,
    ).select("id", F.round("score", 6).alias("score")),
    f"WITH m AS (SELECT id, score FROM (SELECT doc_id AS id, {_SCORE} AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 1000), s AS (SELECT m.id, 0.5 * score + 0.3 * coalesce(label / 10.0::DOUBLE, 0) + 0.2 * CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS score FROM m LEFT JOIN embeddings ON vec_id = m.id LEFT JOIN nation ON n_nationkey = m.id) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 25", "2.17")
