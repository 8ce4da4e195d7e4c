"""Null logic, edge cases and round trips of the library's own functions."""

import json
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt import dialect
from basalt.functions import json_paths
from basalt.functions.mysql import call, java_pattern, register
from basalt.operators import audit, dml, geo, graph, metadata, nearest, scalar, security, text, vector
from basalt.operators.catalog import Catalog, ConstraintError
from basalt.operators.quantified import quantified
from basalt.plans import unified
from basalt.sources import files
from basalt.streaming import windows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_functions_follow_the_flavour(spark):
    register(spark)
    row = one(spark, call("week", "DATE'2008-02-20'").alias("w"), call("yearweek", "DATE'1987-01-01'").alias("y"), call("greatest", "1", "NULL").alias("g"),
              call("elt", "9", "'a'").alias("e"), call("mod", "5", "0").alias("m"), call("is_ipv6", "'::1'").alias("v6"), call("format", "1234.5D", "2").alias("f"))
    assert (row.w, row.y, row.g, row.e, row.m, row.v6, row.f) == (7, 198652, None, None, None, True, "1,234.50")
    assert java_pattern("%d/%m/%Y at %H:%i") == "dd/MM/yyyy 'a''t' HH:mm"


def test_json_paths():
    assert json_paths.assign({"a": [1]}, "$.a[0]", 5, "set") == {"a": [5]}
    assert json_paths.assign({"a": 1}, "$.b", 2, "replace") == {"a": 1}
    assert json_paths.assign({"a": 1}, "$.a", 2, "insert") == {"a": 1}
    assert json_paths.remove({"a": [1, 2]}, "$.a[last]") == {"a": [1]}
    assert json_paths.merge_patch({"a": 1, "b": 2}, {"b": None, "c": {"d": None}}) == {"a": 1, "c": {}}
    assert json_paths.merge_preserve({"a": 1}, {"a": 2}) == {"a": [1, 2]}
    assert json_paths.array_insert([1, 3], "$[1]", 2) == [1, 2, 3]
    with pytest.raises(ValueError):
        json_paths.steps("a.b")


def test_dialect_texts():
    t = dialect.translate
    assert t("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5"
    assert t("SELECT 'LIMIT 1, 2' FROM t -- x") == "SELECT 'LIMIT 1, 2' FROM t"
    assert t("a STRAIGHT_JOIN b") == "a JOIN b"
    assert t("SELECT x = ANY (SELECT y FROM t)") == "SELECT x IN (SELECT y FROM t)"
    assert "listagg(DISTINCT CAST(a AS STRING), '-')" in t("SELECT GROUP_CONCAT(DISTINCT a SEPARATOR '-') FROM t")
    assert t("SELECT DATE_SUB(d, INTERVAL 1 DAY)") == "SELECT (d - INTERVAL 1 DAY)"


def test_quantified_three_valued_logic(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    for values, op, q, want in [
        ([], ">", "all", [True] * 3), ([], "=", "any", [False] * 3), ([2, None], ">", "all", [False, None, None]), ([2, None], ">", "any", [None, True, None]),
        ([1, None], "=", "any", [True, None, None]), ([1, None], "<>", "all", [False, None, None]), ([5, 5], "=", "all", [False, True, None]), ([1, 5], "<>", "any", [True, True, None]),
    ]:
        v = spark.createDataFrame([(x,) for x in values], "v int")
        got = {r.x: r.r for r in quantified(rows, "x", op, q, v, "v", "r").collect()}
        assert [got[1], got[5], got[None]] == want, (values, op, q)


def test_merge_takes_the_last_change_and_keeps_unknown(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "m", 1)], "k int, v string, at int")
    got = dml.merge(target, source, ["k"], {"v": "s.v"}, order_by=["at"]).collect()
    assert sorted((r.k is None, r.k or 0, r.v) for r in got) == [(False, 1, "a"), (False, 2, "y"), (False, 3, "z"), (True, 0, "m"), (True, 0, "n")]
    assert dml.delete(target, "k > 1").count() == 2
    assert sorted(r.v for r in dml.replace_into(target, source.drop("at"), ["k"]).collect()) == ["a", "m", "n", "y", "z"]
    assert [r.n for r in dml.unique_violations(target.unionByName(target), ["k"]).collect()] == [2, 2]


def test_times_of_late_years_have_no_sign(spark):
    row = one(spark, call("from_unixtime", "CAST(3000000 AS BIGINT) * 86399").alias("late"), call("from_unixtime", "0").alias("first"), call("from_unixtime", "CAST(NULL AS BIGINT)").alias("none"))
    assert tuple(row) == ("10183-08-17 06:40:00", "1970-01-01 00:00:00", None)


def test_vector_edge_cases(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    row = one(spark, vector.cosine_similarity(a, a).alias("s"), vector.cosine_similarity(a, F.array(F.lit(1.0))).alias("m"), vector.cosine_similarity(a, F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vector.similarity(a, a, "euclidean").alias("e"))
    assert tuple(row) == (1.0, 0.0, 0.0, 1.0)
    books = [[[0.0], [1.0]], [[0.0], [2.0]]]
    row = spark.createDataFrame([([0.9, 1.8], [1.0, 0.0])], "v array<double>, q array<double>")
    row = row.select(vector.product_codes(F.col("v"), books).alias("codes"), vector.distance_tables(F.col("q"), books).alias("tables")).first()
    assert sum(t[c] for t, c in zip(row.tables, row.codes, strict=True)) == 4.0


def test_text(spark):
    got = one(spark, text.tokens(F.lit("Hello World, this is a test!")).alias("t")).t
    assert got == ["hello", "world", "test"]


def test_hash_embedding_takes_time_by_words_only(spark):
    docs = spark.range(300).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, "id"), F.lit(700)).cast("string"))), " ").alias("text"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "the of"), (-4, "Alpha alpha beta")], "id bigint, text string")
    docs = docs.unionByName(odd)
    began = time.time()
    got = {r.id: r.v for r in docs.select("id", text.hash_embedding(F.col("text")).alias("v")).collect()}
    assert time.time() - began < 30
    words = docs.filter("id < 3").select("id", F.explode(text.tokens(F.col("text"))).alias("w"))
    places = words.selectExpr("id", "CAST(pmod(xxhash64(w), 64) AS INT) AS i", "if(getbit(xxhash64(w, 1), 0) = 1, 1, -1) AS s").groupBy("id", "i").agg(F.sum("s").alias("s")).collect()
    want = {i: [0.0] * 64 for i in [*range(3), *range(-4, 0)]}
    for r in places:
        want[r.id][r.i] = float(r.s)
    for i, v in want.items():
        length = sum(x * x for x in v) ** 0.5 or 1.0
        assert got[i] == pytest.approx([x / length for x in v], abs=1e-12)
    assert len(got) == 304


def test_inverted_lists_reach_recall_by_default(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    index, exact = vector.InvertedLists(v, 16), vector.knn(v, queries, 10, "euclidean")
    assert vector.recall(index.search_all(queries, 10), exact) >= 0.9
    one_by_one = [r.id for r in index.search(list(queries.filter("qid = 20").first().q), 10).collect()]
    assert one_by_one == [r.id for r in index.search_all(queries, 10).filter("qid = 20").orderBy("rank").collect()]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "e"), (2, 3, "e"), (2, 5, "e"), (3, 4, "e")], "src bigint, dst bigint, label string")
    g = graph.Graph(spark.createDataFrame([(i, "N") for i in range(1, 6)], "id bigint, label string"), edges)
    start = spark.createDataFrame([(1,)], "id bigint")
    assert sorted(r.id for r in graph.multi_hop(g, start, 2).collect()) == [3, 5]
    assert sorted(r.id for r in graph.multi_hop(g, start, 2, "within").collect()) == [2, 3, 5]
    tree = graph.bfs(g, start)
    assert {r.id: r.distance for r in tree.collect()} == {1: 0, 2: 1, 3: 2, 5: 2, 4: 3}
    assert graph.path_to(tree, 4) == [1, 2, 3, 4] and graph.path_to(tree, 9) == []
    walk = graph.dfs(graph.Graph(None, edges.withColumn("component", F.lit(1).cast("bigint"))))
    assert {r.id: (r.discovered, r.finished) for r in walk.collect()} == {1: (1, 10), 2: (2, 9), 3: (3, 6), 4: (4, 5), 5: (7, 8)}


def test_long_chains_are_walked_to_their_end(spark):
    chain = spark.range(67).selectExpr("id AS child", "id + 1 AS parent")
    assert {r.id: r.depth for r in graph.lineage(chain, 0).collect()} == {i: i for i in range(68)}
    assert graph.lineage(chain, 0, 3).count() == 4


@pytest.mark.parametrize("wkt", ["POINT (1 2)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT (1 1, 2 2)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"])
def test_geometry_round_trips(wkt):
    g = geo.parse_wkt(wkt)
    assert geo.to_wkt(g) == wkt
    assert geo.parse_wkb(geo.to_wkb(g)) == g == geo.parse_wkb(geo.to_wkb(g, ">"))


def test_geometry_predicates():
    box = geo.parse_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))")
    at = lambda x, y: ("POINT", (float(x), float(y)))
    assert geo.contains(box, at(1, 1)) and geo.contains(box, at(10, 3)) and not geo.contains(box, at(5, 5)) and not geo.contains(box, at(15, 15))
    assert geo.intersects(box, geo.parse_wkt("LINESTRING(-5 5, 20 5)")) and not geo.intersects(box, at(11, 0))
    assert geo.distance(box, at(13, 14)) == 5.0
    assert not geo.validate(geo.parse_wkt("POLYGON((0 0, 1 0, 1 1))"))


def test_masks_policies_and_rows(spark):
    df = spark.createDataFrame([("alice@example.org", 20000.0), ("abc", None), (None, 1.0)], "email string, salary double")
    got = security.masked(df, {"email": "partial", "salary": "range"}).collect()
    assert [tuple(r) for r in got] == [("alic*********.org", "10K - 50K"), ("*c", None), (None, "< 10K")]
    rls = security.RowSecurity()
    assert rls.apply(df, "u", "t").count() == 3
    rls.grant("u", "t", "salary > 5")
    assert rls.apply(df, "u", "t").count() == 1 and rls.apply(df, "w", "t").count() == 0


def test_chain_and_fingerprints(spark):
    rows = [(i, f"2024-01-01 00:00:0{i}", "u", "UPDATE", "t", "r") for i in range(5)]
    log = spark.createDataFrame(rows, "seq bigint, ts string, user_id string, action string, table_name string, record_id string").withColumn("ts", F.to_timestamp("ts"))
    previous, entries = audit.GENESIS, []
    for r in log.orderBy("seq").collect():
        one_row = spark.createDataFrame([r], log.schema)
        h = one_row.select(audit.entry_hash(F.lit(previous)).alias("h")).first().h
        entries.append((*r, previous, h))
        previous = h
    chained = spark.createDataFrame(entries, [*log.columns, "prev_hash", "hash"])
    assert audit.verify_chain(chained, 2).collect() == []
    broken = chained.withColumn("action", F.when(F.col("seq") == 2, "DELETE").otherwise(F.col("action"))).filter("seq <> 3")
    assert sorted(tuple(r) for r in audit.verify_chain(broken, 2).collect()) == [(2, "checksum"), (4, "gap"), (4, "link")]
    s = spark.createDataFrame([("SELECT  * FROM t WHERE a = 'x''y' AND b IN (1, 2)",)], "sql string").select(metadata.fingerprint(F.col("sql")).alias("f")).first().f
    assert s == "select * from t where a = ? and b in (?)"


def test_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"name": "t", "columns": [{"name": "id", "data_type": "INTEGER", "nullable": False}, {"name": "n", "data_type": "TEXT", "nullable": True}], "rows": [[{"Integer": 1}, {"Text": "a"}], [{"Integer": 2}, None]]}))
    assert [tuple(r) for r in files.read_json_table(spark, str(tmp_path / "t.json")).orderBy("id").collect()] == [(1, "a"), (2, None)]
    (tmp_path / "d.sql").write_text("CREATE TABLE `u` (\n `id` INT NOT NULL,\n `s` VARCHAR(20),\n PRIMARY KEY (`id`)\n);\nINSERT INTO `u` VALUES (1,'it''s; (x)'),(2,NULL),(3,'a\\nb');\nINSERT INTO `v` VALUES (9);\n")
    assert [tuple(r) for r in files.read_dump(spark, str(tmp_path / "d.sql"), "u").orderBy("id").collect()] == [(1, "it's; (x)"), (2, None), (3, "a\nb")]
    (tmp_path / "r.tbl").write_text("0|AFRICA|x|\n1|ASIA|y|\n")
    assert files.read_tbl(spark, str(tmp_path / "r.tbl"), "k int, n string, c string").count() == 2
    rows = spark.range(10).selectExpr("id", "id % 2 AS p")
    files.write_parquet(rows, str(tmp_path / "out"), ["p"])
    assert files.read_parquet(spark, str(tmp_path / "out"), ["id"], "p = 1").count() == 5
    files.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 10
    assert files.sql_type("DECIMAL(10, 2)") == "decimal(10,2)" and files.sql_type("varchar(5)") == "string"


def test_schedules():
    assert windows.schedule_trigger("EVERY 5 MINUTE") == {"processingTime": "5 minutes"}
    assert windows.schedule_trigger("ONE TIME") == {"availableNow": True}


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS a", "id * 3 AS b").write.parquet(str(tmp_path / "p"))
    plan = "\n".join(r.plan for r in metadata.explain(files.read_parquet(spark, str(tmp_path / "p"), ["a"], "id = 5")).collect())
    assert "EqualTo(id,5)" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan


def test_unified_query_ranks_beyond_its_scored_rows(spark):
    rows = spark.range(1000).withColumn("w", F.col("id"))
    got = [(r.id, r.score) for r in unified.fuse(unified.UnifiedQuery(sql=(rows, "-w"), top_k=60)).collect()]
    assert [i for i, _ in got] == [*range(999, 949, -1), *range(10)]
    assert got[0][1] == 0.4 and abs(got[49][1] - 0.4 * 0.51) < 1e-9 and got[50][1] == got[59][1] == 0.2


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    v = spark.range(300).select("id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).cast("float") for i in range(8)]).alias("v"))
    queries = v.filter("id % 7 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    key = lambda df: sorted((r.qid, r.id, r["rank"]) for r in df.collect())
    whole = key(vector.knn(v, queries, 4, "euclidean"))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 10)
    assert key(vector.knn(v, queries, 4, "euclidean")) == whole and len(whole) == 4 * 43


def _odd_vectors(spark):
    """Copies, ties, other lengths, zeros, an empty and a null vector, null and repeated ids."""
    v = spark.range(400).select("id", F.array(*[(F.pmod(F.xxhash64(F.col("id") % 300, F.lit(i)), F.lit(7)) - 3).cast("float") for i in range(6)]).alias("v"))
    odd = [(None, [1.0] * 6), (-1, [0.0] * 6), (-2, [1.0, 2.0]), (-3, []), (-4, None), (3, [1.0] * 6), (3, [1.0] * 6), (-5, [1e30] * 6)]
    return v.unionByName(spark.createDataFrame(odd, "id bigint, v array<float>"))


@pytest.mark.parametrize("metric", vector.METRICS)
def test_knn_gives_the_distances_of_the_expressions(spark, metric, monkeypatch):
    v = _odd_vectors(spark)
    queries = v.filter("id % 7 = 0 OR id < 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    order = Window.partitionBy("qid").orderBy("distance", "id")
    pairs = v.crossJoin(queries).select("qid", "id", vector.distance(F.col("v"), F.col("q"), metric).alias("distance"))
    key = lambda df: sorted((r.qid, r["rank"], r.id is not None, r.id, r.distance + 0.0) for r in df.collect())
    want = key(pairs.withColumn("rank", F.row_number().over(order)).filter("rank <= 9"))
    assert key(vector.knn(v, queries, 9, metric)) == want and len(want) == 9 * queries.count()
    monkeypatch.setattr(nearest, "AT_ONCE", 7)
    assert nearest.BLOCK > 0 and key(vector.knn(v.repartition(3), queries, 9, metric)) == want


def test_kernel_finds_the_same_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    v, fits = rng.integers(-2, 3, (500, 4)).astype(float), np.ones(500, bool)
    part = nearest.Queries(pa.array(range(40)), v[:40])
    gaps = np.sqrt(((v[:40, None] - v) ** 2).sum(axis=2))
    want = [[int(i) for i in np.lexsort((np.arange(500), row))[:6]] for row in gaps]
    for size in (500, 3000, 4_000_000):
        monkeypatch.setattr(nearest, "BLOCK", size)
        got = [(int(q), int(r)) for qi, ri, _ in nearest.nearest(part, v, fits, 6, "euclidean") for q, r in zip(qi, ri, strict=True)]
        assert got == [(q, r) for q, rows in enumerate(want) for r in rows]


def test_searches_of_many_queries_cost_little_by_pair(spark):
    v = spark.range(20_000).select("id", F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).cast("float") for i in range(64)]).alias("v")).repartition(4)
    queries = v.filter("id % 4 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    began = time.time()
    exact = vector.knn(v, queries, 10, "euclidean").cache()
    assert exact.count() == 50_000 and time.time() - began < 30


def test_searches_by_lists_agree_one_by_one(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.distance) for r in df.collect())
    lists = vector.InvertedLists(v, 16)
    assert key(lists.search_all(queries, 10, 16)) == key(vector.knn(v, queries, 10, "euclidean"))
    for probes in (1, 5):
        for qid in (20, 480):
            alone = lists.search(list(queries.filter(F.col("qid") == qid).first().q), 10, probes).collect()
            assert [(r.id, r.distance) for r in alone] == [x[2:] for x in key(lists.search_all(queries, 10, probes)) if x[0] == qid]
    plan = lists.search_all(queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "MapInArrow" in plan


def test_searches_by_codes_shuffle_no_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.distance) for r in df.collect())
    exact, codes = vector.knn(v, queries, 10, "euclidean"), vector.QuantizedLists(v, 16)
    assert vector.recall(codes.search_all(queries, 10), exact) >= 0.9
    assert key(codes.search_all(queries, 10, 16, 500)) == key(exact)
    plan = codes.search_all(queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_search_texts_agrees_with_the_index(spark):
    docs = spark.createDataFrame([(1, "The LICENSE was released, under it"), (2, "licensed under released"), (3, None), (4, ""), (5, "under license: released!")], "doc_id bigint, text string")
    for query in ("license released under", "under", "the", "none of these words"):
        assert {r.doc_id for r in text.search_texts(docs, query).collect()} == {r.doc_id for r in text.search(text.inverted_index(docs), query).collect()}


def shop(spark):
    c = Catalog(spark)
    c.execute("CREATE TABLE parent (id INT PRIMARY KEY, name VARCHAR(9) UNIQUE)")
    c.execute("CREATE TABLE child (id INT PRIMARY KEY, parent INT, n INT DEFAULT 5 CHECK (n < 100), FOREIGN KEY (parent) REFERENCES parent (id))")
    c.execute("INSERT INTO parent VALUES (1, 'a'), (2, 'b'), (3, NULL), (4, NULL)")
    c.execute("INSERT INTO child (id, parent) VALUES (1, 1), (2, NULL)")
    return c


def test_statements_that_break_constraints_change_nothing(spark):
    c = shop(spark)
    for statement in (
        "INSERT INTO parent VALUES (1, 'c')", "INSERT INTO parent VALUES (9, 'a')", "INSERT INTO parent VALUES (NULL, 'z')", "INSERT INTO child (id, parent) VALUES (3, 77)",
        "INSERT INTO child VALUES (3, 1, 100)", "UPDATE child SET n = 200 WHERE id = 1", "CREATE UNIQUE INDEX u ON child (n)",
    ):
        with pytest.raises(ConstraintError):
            c.execute(statement)
    assert sorted(tuple(r) for r in c.execute("SELECT * FROM child").collect()) == [(1, 1, 5), (2, None, 5)]
    c.execute("CREATE TABLE IF NOT EXISTS child (x INT)")
    c.execute("DROP TABLE IF EXISTS nothing")
    with pytest.raises(ValueError, match="exists"):
        c.execute("CREATE TABLE child (x INT)")


def test_triggers_procedures_and_indexes(spark):
    c = shop(spark)
    c.execute("CREATE TABLE log (id INT, before INT, after INT)")
    c.execute("CREATE TRIGGER t AFTER UPDATE ON child FOR EACH ROW INSERT INTO log (id, before, after) VALUES (OLD.id, OLD.n, NEW.n)")
    c.execute("CREATE TRIGGER s BEFORE UPDATE ON child FOR EACH ROW SET NEW.n = NEW.n + 1")
    c.execute("UPDATE child SET n = id * 10 WHERE id = 2")
    assert [tuple(r) for r in c.execute("SELECT * FROM log").collect()] == [(2, 5, 21)]
    c.execute("CREATE PROCEDURE of_parent (IN p INT) BEGIN SELECT id, n FROM child WHERE parent = p; END")
    assert [tuple(r) for r in c.execute("CALL of_parent(1)").collect()] == [(1, 5)]
    c.execute("CREATE INDEX i ON child (parent, n)")
    assert [(r.index_name, r.seq_in_index, r.column_name) for r in c.execute("SHOW INDEX FROM child").collect()] == [("PRIMARY", 1, "id"), ("i", 1, "parent"), ("i", 2, "n")]
    c.execute("DROP INDEX i ON child")
    assert c.execute("SHOW INDEX FROM child").count() == 1


def test_json_functions_give_rows(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, "[]"), (3, "7"), (4, None)], "id int, doc string")
    assert sorted(tuple(r) for r in scalar.json_each(rows, "doc", "id").collect()) == [(1, "a", '[1,{"b":null}]'), (1, "c", '"x"')]
    tree = {(r.id, r.path, r.depth, r.type) for r in scalar.json_tree(rows.filter("doc IS NOT NULL"), "doc", "id").collect()}
    assert tree == {(1, "$", 0, "object"), (1, "$.a", 1, "array"), (1, "$.a[0]", 2, "number"), (1, "$.a[1]", 2, "object"), (1, "$.a[1].b", 3, "null"), (1, "$.c", 1, "text"), (2, "$", 0, "array"), (3, "$", 0, "number")}


def test_broken_links_and_descendants(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 4), (5, 99)], "child bigint, parent bigint")
    records = spark.range(6)
    assert {tuple(r) for r in graph.broken_links(edges, records).collect()} == {(4, 4, "self"), (5, 99, "missing")}
    assert {tuple(r) for r in graph.descendants(edges, 0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 2)}


@pytest.mark.parametrize(
    ("a", "b", "touch", "cross", "overlap"),
    [
        ("POINT(0 0)", "LINESTRING(0 0,1 0)", True, False, False),
        ("POINT(0.5 0)", "LINESTRING(0 0,1 0)", False, False, False),
        ("MULTIPOINT(0.5 0,9 9)", "LINESTRING(0 0,1 0)", False, True, False),
        ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", False, True, False),
        ("LINESTRING(0 0,2 0)", "LINESTRING(1 0,3 0)", False, False, True),
        ("LINESTRING(0 0,1 0)", "LINESTRING(1 0,2 0)", True, False, False),
        ("LINESTRING(0 0,4 0)", "POLYGON((0 0,4 0,4 4,0 4,0 0))", True, False, False),
        ("LINESTRING(1 1,9 1)", "POLYGON((0 0,4 0,4 4,0 4,0 0))", False, True, False),
        ("LINESTRING(1 1,2 1)", "POLYGON((0 0,4 0,4 4,0 4,0 0))", False, False, False),
        ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((0 0,4 0,4 4,0 4,0 0))", False, False, False),
        ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((2 -1,3 -1,3 5,2 5,2 -1))", False, False, True),
        ("POLYGON((0 0,4 0,4 4,0 4,0 0))", "POLYGON((4 4,5 4,5 5,4 5,4 4))", True, False, False),
        ("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))", "POLYGON((1 1,8 1,8 8,1 8,1 1))", True, False, False),
    ],
)
def test_relations_of_boundaries(a, b, touch, cross, overlap):
    for x, y in ((a, b), (b, a)):
        x, y = geo.parse_wkt(x), geo.parse_wkt(y)
        assert (geo.touches(x, y), geo.crosses(x, y), geo.overlaps(x, y)) == (touch, cross, overlap)
