"""Vector metrics, exact and inverted-list search, hybrid search and score fusion.

Vectors are array<float> columns; arithmetic is in doubles. Searches of one query stay in the JVM; those of many queries
run the kernel of nearest.py over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators import nearest
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load
from basalt.sources.shared import stored

METRICS = ("cosine", "euclidean", "dot", "manhattan")
#: Queries per block of an exact search; a block is broadcast, its size bounded by this and the dimension.
QUERY_BLOCK = 10_000
#: The share of an index's lists that a search probes by default.
PROBED = 0.75


def _sum(a: Column, b: Column, pair) -> Column:
    terms = F.zip_with(a, b, lambda x, y: pair(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _fits(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for a mismatch of length, an empty vector or a zero norm."""
    scale = norm(a) * norm(b)
    return F.when(_fits(a, b) & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - similarity; dot: its negative. A mismatch of length is infinitely far for the others."""
    far = F.lit(float("inf"))
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "dot":
        return -F.when(_fits(a, b), dot(a, b)).otherwise(0.0)
    if metric == "euclidean":
        return F.when(_fits(a, b), F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))).otherwise(far)
    if metric == "manhattan":
        return F.when(_fits(a, b), _sum(a, b, lambda x, y: F.abs(x - y))).otherwise(far)
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine and dot: themselves; distances d: 1 / (1 + d)."""
    if metric in ("cosine", "dot"):
        return (1 if metric == "cosine" else 0) - distance(a, b, metric)
    return 1 / (1 + distance(a, b, metric))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", predicate: str | None = None) -> DataFrame:
    """The k nearest vectors(id, v) of each of queries(qid, q): qid, id, distance, rank; ties go by id.

    Queries are a stated set, searched in broadcast blocks of about QUERY_BLOCK against all vectors; each task keeps its own
    best k per query before anything is shuffled.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    rows = vectors.filter(predicate) if predicate else vectors

    def block(parts: list[nearest.Queries], table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v, fits = nearest.matrix(table.column("v").combine_chunks(), part.q.shape[1])
            yield from _found(part, table, nearest.nearest(part, v, fits, k, metric))

    return _best(rows.select("id", "v"), queries, k, lambda parts: parts, block)


def _found(part: nearest.Queries, table: pa.Table, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for qi, ri, distance in found:
        yield pa.RecordBatch.from_arrays([part.ids.take(pa.array(qi)), table.column("id").combine_chunks().take(pa.array(ri)), pa.array(distance)], ["qid", "id", "distance"])


def _best(rows: DataFrame, queries: DataFrame, k: int, prepared: Callable, block: Callable) -> DataFrame:
    """qid, id, distance, rank: the best k that block(queries, rows) finds in blocks of the rows, for prepared() blocks of the queries."""
    context = rows.sparkSession.sparkContext
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    count = -(-queries.count() // QUERY_BLOCK)
    mine = F.pmod(F.xxhash64("qid"), F.lit(max(count, 1)))

    def one(i: int) -> DataFrame:
        wanted = queries.select("qid", "q")
        shared = context.broadcast(prepared(nearest.by_length((wanted.filter(mine == i) if count > 1 else wanted).toArrow())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in nearest.blocks(batches):
                yield from block(shared.value, table)

        found = rows.mapInArrow(run, schema)
        own = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [one(i) for i in range(max(count, 1))])


def search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", predicate: str | None = None) -> DataFrame:
    """Top k of one query vector: id, score (similarity); a TakeOrderedAndProject, no full sort."""
    rows = vectors.filter(predicate) if predicate else vectors
    scored = rows.select("id", similarity(F.col("v"), F.lit([float(x) for x in query]), metric).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def sharded_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", shards: int = 8) -> DataFrame:
    """search() over shards by hash of the id: every shard gives its own k, and each id counts once among them, with its best score."""
    scored = vectors.select("id", similarity(F.col("v"), F.lit([float(x) for x in query]), metric).alias("score"))
    own = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(shards))).orderBy(F.desc("score"), "id")
    best = scored.groupBy("id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k)
    return best.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def within(vectors: DataFrame, query: list[float], radius: float, metric: str = "euclidean") -> DataFrame:
    """Range search: id and distance of vectors at most radius away."""
    return vectors.select("id", distance(F.col("v"), F.lit([float(x) for x in query]), metric).alias("distance")).filter(F.col("distance") <= radius)


class InvertedLists:
    """An IVF index: k-means centroids fitted on a bounded sample, every vector in the list of its nearest centroid.

    The table is stored with a directory for each list, so a search reads the lists that it probes and no others.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, sample: int = 20_000, seed: int = 42) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        ordered = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"), F.xxhash64("id").alias("h"))
        model = KMeans(k=lists, seed=seed).fit(ordered.orderBy("h").limit(sample))
        self.centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        nearest = F.array_min(F.array(*[F.struct(distance(F.col("v"), F.lit(c), "euclidean").alias("d"), F.lit(i).alias("list")) for i, c in enumerate(self.centroids)]))
        self.table = stored(self._entries(vectors).withColumn("list", nearest["list"]), "inverted-lists", "list")
        self.probes = max(1, math.ceil(PROBED * len(self.centroids)))

    def _entries(self, vectors: DataFrame) -> DataFrame:
        return vectors

    def search(self, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """Top k among the lists nearest to the query: id, distance."""
        probes = probes or self.probes
        order = sorted(range(len(self.centroids)), key=lambda i: sum((x - y) ** 2 for x, y in zip(self.centroids[i], query, strict=True)))
        rows = self.table.filter(F.col("list").isin(order[:probes]))
        scored = rows.select("id", distance(F.col("v"), F.lit([float(x) for x in query]), "euclidean").alias("distance"))
        return scored.orderBy("distance", "id").limit(k)

    def search_all(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """search() for each of queries(qid, q), as in knn() a stated set: qid, id, distance, rank."""
        return self._search_all(queries, k, probes, ["id", "v", "list"], lambda table: {})

    def _search_all(self, queries: DataFrame, k: int, probes: int | None, columns: list[str], more: Callable) -> DataFrame:
        centroids, probes = np.array(self.centroids), probes or self.probes

        def prepared(parts: list[nearest.Queries]) -> list[nearest.Queries]:
            """The parts with the lists that are nearest to each query."""
            for part in parts:
                far = np.full((len(part.q), len(centroids)), np.inf)
                if part.q.shape[1] == centroids.shape[1]:
                    far = np.stack([nearest.exact(part.q, np.broadcast_to(c, part.q.shape), "euclidean") for c in centroids], axis=1)
                part.probed = np.zeros(far.shape, bool)
                np.put_along_axis(part.probed, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
            return parts

        def block(parts: list[nearest.Queries], table: pa.Table) -> Iterator[pa.RecordBatch]:
            lists, given = table.column("list").to_numpy(), more(table)
            for part in parts:
                v, fits = nearest.matrix(table.column("v").combine_chunks(), part.q.shape[1])
                rows = given if part.q.shape[1] == centroids.shape[1] else {}
                yield from _found(part, table, nearest.nearest(part, v, fits, k, "euclidean", lists, **rows))

        return _best(self.table.select(*columns), queries, k, prepared, block)


class QuantizedLists(InvertedLists):
    """IVF-PQ: inverted lists whose entries carry product codes; codes choose `keep` candidates per query, their vectors rank them."""

    def __init__(self, vectors: DataFrame, lists: int = 16, parts: int = 16, words: int = 32, sample: int = 20_000, seed: int = 42) -> None:
        self.codebooks = train_codebooks(vectors, parts, words, sample, seed)
        super().__init__(vectors, lists, sample, seed)

    def _entries(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("codes", product_codes(F.col("v"), self.codebooks))

    def search_all(self, queries: DataFrame, k: int = 10, probes: int | None = None, keep: int | None = None) -> DataFrame:
        """qid, id, distance, rank: the best k of the `keep` (30 * k) nearest by codes, which every block of rows picks for itself.

        So the `keep` nearest of all rows are among those that vectors rank, however the rows lie, and no vector leaves its block.
        """
        books = [np.array(book) for book in self.codebooks]

        def decoded(table: pa.Table) -> dict:
            """The distance to what codes stand for is the sum that the tables of distances give."""
            codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, len(books))
            return {"decoded": np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1), "keep": keep or 30 * k}

        return self._search_all(queries, k, probes, ["id", "v", "list", "codes"], decoded)


def train_codebooks(vectors: DataFrame, parts: int, words: int, sample: int = 20_000, seed: int = 42) -> list[list[list[float]]]:
    """Codebooks of a product quantizer: k-means of each of `parts` equal slices of the vectors, on at most `sample` of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = stored(vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("v").cast("array<double>").alias("v")), "codebook-sample")
    first = rows.first()
    if first is None or len(first.v) % parts:
        raise ValueError("vectors must divide into the parts evenly")
    width = len(first.v) // parts
    slices = [rows.select(array_to_vector(F.slice("v", m * width + 1, width)).alias("features")) for m in range(parts)]
    return [[[float(x) for x in c] for c in KMeans(k=words, seed=seed, maxIter=8).fit(s).clusterCenters()] for s in slices]


def product_codes(v: Column, codebooks: list[list[list[float]]]) -> Column:
    """The nearest codeword of every slice of a vector."""
    return F.transform(distance_tables(v, codebooks), lambda t: F.array_position(t, F.array_min(t)).cast("int") - 1)


def distance_tables(v: Column, codebooks: list[list[list[float]]]) -> Column:
    """For every slice its squared distances to all codewords."""
    width = len(codebooks[0][0])
    gap = lambda a, w: F.aggregate(F.zip_with(a, w, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    table = lambda part, book: F.transform(F.lit(book), lambda w: gap(part, w))
    return F.array(*[table(F.slice(v, m * width + 1, width), book) for m, book in enumerate(codebooks)])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (qid, id) that found holds."""
    return found.select("qid", "id").join(exact.select("qid", "id"), ["qid", "id"]).count() / max(exact.count(), 1)


def hybrid(sql_scores: DataFrame, vector_scores: DataFrame, alpha: float = 0.5, beta: float = 0.5, k: int = 10) -> DataFrame:
    """id and score = alpha * sql + beta * vector over ids that both (id, score) frames hold."""
    both = sql_scores.select("id", F.col("score").alias("a")).join(vector_scores.select("id", F.col("score").alias("b")), "id")
    return both.select("id", (alpha * F.col("a") + beta * F.col("b")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(modes: dict[str, DataFrame], method: str = "rrf", weights: dict[str, float] | None = None, constant: int = 60, bonus: float = 0.1, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """Fusion of ranked (id, score) lists: id, score, modes.

    rrf: sum of weight / (constant + rank) plus a bonus for ids in several lists; linear: weighted mean of
    scores; composite: 0.7 rrf + 0.3 mean score; max: greatest weighted score. The lists are results of top-k
    searches, so each is as short as its k.
    """
    weights = weights or {}
    rows = None
    for name, frame in modes.items():
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        part = frame.withColumn("rank", rank).select("id", "score", "rank", F.lit(float(weights.get(name, 1.0))).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    grouped = rows.groupBy("id").agg(
        F.sum(F.col("w") / (constant + F.col("rank"))).alias("rrf"),
        (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("mean"),
        F.max(F.col("w") * F.col("score")).alias("top"),
        F.count("*").alias("modes"),
    )
    rrf = F.col("rrf") + F.when(F.col("modes") > 1, bonus).otherwise(0.0)
    score = {"rrf": rrf, "linear": F.col("mean"), "composite": 0.7 * F.col("rrf") + 0.3 * F.col("mean"), "max": F.col("top")}[method]
    return grouped.select("id", score.alias("score"), "modes").filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).filter("id = 0").first().v)


_DUCK = {
    "cosine": "1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))",
    "euclidean": "sqrt(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "dot": "-list_dot_product(v, q)",
    "manhattan": "list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2])))",
}
_ALL = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _metric(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = F.lit(_first(spark, sf_dir))
        return _vectors(spark, sf_dir).select("id", F.round(distance(F.col("v"), q, metric), 6).alias("distance"))

    OPERATORS[f"vector_{metric}"] = Operator(run, f"SELECT a.id, round({_DUCK[metric]}, 6) AS distance FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0)", "2.10")


for _m in METRICS:
    _metric(_m)


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return knn(v, queries, 5, "euclidean").select("qid", "id", F.round("distance", 5).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


OPERATORS["vector_knn"] = Operator(
    _knn,
    f"SELECT * EXCLUDE (d), round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT qid, id, {_DUCK['euclidean']} AS d FROM {_ALL} a, (SELECT id AS qid, v AS q FROM {_ALL} WHERE id % 20 = 0))) WHERE rank <= 5",
    "2.10",
)
OPERATORS["vector_search_filtered"] = Operator(
    lambda spark, d: search(_vectors(spark, d), _first(spark, d), 10, "cosine", "label < 5").select("id", F.round("score", 6).alias("score")),
    f"SELECT id, round(1 - ({_DUCK['cosine']}), 6) AS score FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0) WHERE label < 5 ORDER BY {_DUCK['cosine']}, id LIMIT 10",
    "2.10",
)
OPERATORS["vector_range"] = Operator(
    lambda spark, d: within(_vectors(spark, d), _first(spark, d), 1.4).select("id"),
    f"SELECT id FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0) WHERE {_DUCK['euclidean']} <= 1.4",
    "2.10",
)
OPERATORS["vector_ivf"] = Operator(lambda spark, d: InvertedLists(_vectors(spark, d).select("id", "v"), 16).search(_first(spark, d), 10, 16).select("id", F.round("distance", 5).alias("distance")),
    f"SELECT id, round({_DUCK['euclidean']}, 5) AS distance FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0) ORDER BY {_DUCK['euclidean']}, id LIMIT 10", "2.10")


def _ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with its default probes against knn(), over all queries: their number, and whether recall reaches 0.9."""
    v = _vectors(spark, sf_dir).select("id", "v")
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = InvertedLists(v, 16).search_all(queries, 10).select("qid", "id", F.lit(1).alias("hit"))
    both = knn(v, queries, 10, "euclidean").select("qid", "id").join(found, ["qid", "id"], "left")
    return both.agg(F.count_distinct("qid").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


def _ivfpq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _ivf_recall(), with product codes."""
    v = _vectors(spark, sf_dir).select("id", "v")
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = QuantizedLists(v, 16).search_all(queries, 10).select("qid", "id", F.lit(1).alias("hit"))
    both = knn(v, queries, 10, "euclidean").select("qid", "id").join(found, ["qid", "id"], "left")
    return both.agg(F.count_distinct("qid").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


OPERATORS["vector_ivfpq_recall"] = Operator(_ivfpq_recall, "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0", "2.10")
OPERATORS["vector_sharded"] = Operator(
    lambda spark, d: sharded_search(_vectors(spark, d).unionByName(_vectors(spark, d).filter("id < 50")), _first(spark, d), 10).select("id", F.round("score", 6).alias("score")),
    f"SELECT id, round(1 - ({_DUCK['cosine']}), 6) AS score FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0) ORDER BY {_DUCK['cosine']}, id LIMIT 10",
    "2.10",
)
OPERATORS["vector_ivf_recall"] = Operator(_ivf_recall, "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0", "2.10")

def _modes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = _vectors(spark, sf_dir)
    near = search(v.select("id", "v"), _first(spark, sf_dir), 50, "cosine")
    plain = v.select("id", (1 - F.least(F.col("id") * 0.01, F.lit(0.5))).alias("score"))
    return {"sql": plain.orderBy(F.desc("score"), "id").limit(50), "vector": near}


_MODES = f"""WITH near AS (SELECT id, 1 - ({_DUCK['cosine']}) AS score FROM {_ALL} a, (SELECT v AS q FROM {_ALL} WHERE id = 0) ORDER BY score DESC, id LIMIT 50),
 plain AS (SELECT id, 1 - least(id * 0.01::DOUBLE, 0.5) AS score FROM {_ALL} ORDER BY score DESC, id LIMIT 50)"""
OPERATORS["hybrid_search"] = Operator(
    lambda spark, d: hybrid(*_modes(spark, d).values()).select("id", F.round("score", 6).alias("score")),
    f"{_MODES} SELECT id, round(0.5 * p.score + 0.5 * n.score, 6) AS score FROM plain p JOIN near n USING (id) ORDER BY 0.5 * p.score + 0.5 * n.score DESC, id LIMIT 10", "2.10")
_RANKED = f"""{_MODES}, ranked AS (
 SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM near
 UNION ALL SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM plain),
 g AS (SELECT id, sum(1 / (60 + r)) AS rrf, avg(score) AS mean, max(score) AS top, count(*) AS modes FROM ranked GROUP BY id)"""
for _name, _score in (("rrf", "rrf + CASE WHEN modes > 1 THEN 0.1 ELSE 0 END"), ("linear", "mean"), ("composite", "0.7 * rrf + 0.3 * mean"), ("max", "top")):
    OPERATORS[f"fusion_{_name}"] = Operator(
        lambda spark, d, m=_name: fuse(_modes(spark, d), m).select("id", F.round("score", 6).alias("score"), "modes"),
        f"{_RANKED} SELECT id, round({_score}, 6) AS score, modes FROM g ORDER BY {_score} DESC, id LIMIT 10", "2.10")
