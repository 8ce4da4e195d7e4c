import random
import re

import xxhash
from pyspark.sql import functions as F

from basalt.llm import simhash_dedup as op

SCHEMA = "doc_id bigint, text string, a bigint, fp string, key int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, d in enumerate(ids)}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return op.simhash_dedup(df).collect()


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 400]))]
        rows.append((len(rows) * 3 + 7, "  " + " ".join(words)))
        for _ in range(i % 4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "Edit"
            rows.append((len(rows) * 3 + 7, "\n".join(copy).upper()))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "É é x"), (1004, "x " * 70_000)]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([d for d, _ in rows], fps)
    got = run(spark, rows)
    assert {r.doc_id: r.fp % 2**64 for r in got} == {d: f for (d, _), f in zip(rows, fps, strict=True)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 20


def test_links_at_every_distance(spark):
    rng = random.Random(9)
    values = []
    for _ in range(300):
        base = rng.getrandbits(64)
        values.append(base)
        for distance in (1, 2, 3, 4, 5):
            flip = sum(1 << b for b in rng.sample(range(64), distance))
            if distance == 3 and rng.random() < 0.5:
                low = rng.choice([0, 21, 42])
                flip = sum(1 << b for b in rng.sample(range(low, low + 21), 3))
            values.append(base ^ flip)
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = op.link_fingerprints(spark.createDataFrame(signed, "fp bigint"))
    rows = op.components(edges).collect()
    got = {r.node % 2**64: r.root % 2**64 for r in rows}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, v in enumerate(values):
        for u in values[:i]:
            if (u ^ v).bit_count() <= 3:
                root[find(u)] = find(v)
    for i, v in enumerate(values):
        for u in values[max(0, i - 40) : i]:
            assert (find(u) == find(v)) == (got.get(u, u) == got.get(v, v))
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(got.get(v, v))
    assert all(len(g) == 1 for g in groups.values())


def test_repeated_rows_null_ids_and_empty(spark):
    got = run(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (9, "A B C D")])
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.doc_id) == [(False, 1, 1), (False, 1, 1), (False, 9, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [1]
    assert run(spark, []) == []
    kept = op.keep_one(spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "z")], "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == [1, 3]
