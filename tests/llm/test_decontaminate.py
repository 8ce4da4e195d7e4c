import random
import re
from collections import Counter

from pyspark.sql import functions as F

from basalt.llm import decontaminate as op


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items):
    best = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            if not v:
                continue
            a, b = grams(v, k), grams(w, k)
            for t in range(max(1, len(b) - len(a) + 1)):
                x, y = Counter(a), Counter(b[t : t + len(a)])
                both = (x & y).total()
                if both and both / (x | y).total() >= 0.8:
                    best[d, i] = max(best.get((d, i), 0), both / (x | y).total())
    return best


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"Wörd{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([14, 20, 35, 60, 25, 5, 3, 40])] + [(90, None), (91, " .. "), (92, "x x x x x x x x x x")]
    docs = [(0, None), (1, ""), (2, text(5)), (3, "x " * 30), (4, items[6][1]), (5, items[2][1][:-9]), (6, items[0][1] + " " + items[0][1])]
    for j in range(96):
        w = text(rng.choice([10, 200])).split()
        v = items[j % 8][1].split()
        for _ in range((j // 8) % 3):
            v[rng.randrange(len(v))] = "edit"
        if j % 5 == 0 and len(v) > 6:
            del v[len(v) // 2]
        at = rng.randrange(len(w))
        docs.append((100 + j, "! ".join(w[:at] + v + w[at:])))
    frame = spark.createDataFrame([(d, t, 1, "q") for d, t in docs + docs[:9]], "doc_id bigint, text string, n int, h string")
    got = op.find_leaks(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 25
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want)


def test_fingerprint_blocks_cover_64_bits(spark):
    row = spark.sql("select array(1L, 3L, -1L) as a").select(op.simhash(F.col("a")).alias("f")).first()
    assert row.f == 3


def test_index_finds_every_pair_within_the_radius_once(spark):
    rng = random.Random(6)
    item = rng.getrandbits(63)
    flip = lambda n: item ^ sum(1 << b for b in rng.sample(range(63), n))
    items = spark.createDataFrame([(0, 7, [item]), (1, 8, [item])], "item bigint, item_id bigint, s array<bigint>")
    rows = [(i, i, 0, [1], flip(i % 24), [0]) for i in range(480)]
    windows = spark.createDataFrame(rows, "doc_id bigint, th bigint, start int, ws array<bigint>, fp bigint, items array<bigint>")
    got = op.candidates(windows, items).collect()
    assert sorted(r.doc_id for r in got) == list(range(480)) and {r.item_id for r in got} == {7}


def test_many_items_meet_by_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(n))
    items = spark.createDataFrame([(i, text(30)) for i in range(40)] + [(None, text(30)), (3, text(20))], "item_id bigint, text string")
    long = text(60_000)
    docs = spark.createDataFrame([(r.item_id, f"{text(9)} {r.text} {text(4)}") for r in items.collect()] + [(900, long), (901, long + items.first().text)], "doc_id bigint, text string")
    key = lambda rows: sorted((str(r.doc_id), str(r.item_id), r.start, r.similarity) for r in rows)
    few = key(op.find_leaks(docs, items).collect())
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    assert key(op.find_leaks(docs, items).collect()) == few and len(few) == 42 and any(d == "901" for d, *_ in few)


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (1, "z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "a b c d e f g h")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in op.find_leaks(docs, items).collect()] == [(None, 5, 1.0)]
    assert op.find_leaks(docs.limit(0), items).collect() == []
    assert op.find_leaks(docs, items.limit(0)).collect() == []
    assert op.drop_leaks(docs, items).count() == 2
