"""The pipeline's stages on a small corpus, each held against what its own input demands."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    pool = ["".join(rng.choice("aeiounrstlmd") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, prose(25)) for i in range(5)]
    docs, kinds = [], {}

    def add(kind, text):
        kinds[len(docs)] = kind
        docs.append((len(docs), text, "en", f"src{len(docs) % 4}", len(text or "")))

    for i in range(160):
        add("clean", prose(70) + "\n" + prose(70) + ("\nThis footer line stands under many of our pages" if i % 4 == 0 else ""))
    for i in range(30):
        add("junk", " ".join(w + "###" for w in prose(80).split()))
    for i in range(20):
        add("copy", docs[i + 1][1].upper() if i % 2 else docs[i + 1][1])
    for i in range(12):
        words = docs[i + 40][1].split(" ")
        words[20 + i] = words[90] = "edited"
        add("edited", " ".join(words))
    for i in range(10):
        add("leak", prose(40) + " " + items[i % 5][1] + " " + prose(40))
    add("null", None)
    labels = [(i, int(kinds[i] != "junk"), 0) for i in range(0, len(docs), 2)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kinds, items


def test_stages(spark, corpus, tmp_path):
    path, docs, kinds, items = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, path)
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(frame)
    good, lines, single, safe, packed = seen
    assert all(set(s.columns) == COLUMNS for s in seen[:4])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    clean = {i for i, k in kinds.items() if k == "clean"}
    assert not any(kinds[i] == "junk" for i in ids[0]) and clean <= ids[0]
    assert ids[1] == ids[0]
    texts = {r.doc_id: r for r in lines.collect()}
    assert not any("This footer line" in (r.text or "") for r in texts.values())
    assert all(r.n_chars == len(r.text or "") for r in texts.values())
    sets, root = {i: shingles(r.text) for i, r in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and find(i) != find(j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sum(kinds[i] == "edited" for i in ids[2]) == 0
    assert ids[2] == {i for i in texts if find(i) == i} and clean <= ids[2]
    assert not any(kinds[i] == "leak" for i in ids[3]) and clean <= ids[3]
    whole = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    final = {r.doc_id: r.text for r in safe.collect()}
    assert set(pieces) == set(final)
    for i, p in pieces.items():
        assert [x for _, part in sorted(p) for x in part] == [*whole.encode(final[i] or "", add_special_tokens=False).ids, 1]


def test_run_gives_the_last_stage(spark, corpus):
    path, *_ = corpus
    rows = corpus_pipeline.run(spark, path)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_empty_table_and_odd_rows(spark, corpus, tmp_path):
    path, *_ = corpus
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, long, "en", "s", None), (2, long + " end", "en", "s", 5), (2, None, "x", "", 0)], schema)
    odd.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        assert i == 4 or (set(out.columns) == COLUMNS and out.count() <= 5)
