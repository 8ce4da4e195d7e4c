"""Near-duplicate groups at five words and similarity 0.8, against all pairs of small corpora."""

import random

import numpy as np
import pytest

from basalt.llm import simhash_dedup as op

SCHEMA = "doc_id bigint, text string, node int, s string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = op.near_groups(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: [rng.choice(pool) for _ in range(n)]

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = rng.choice(pool)
        return words

    texts = [None, "", " \n", "One two", "one  TWO", "one two three four five", "x " * 400]
    for _ in range(40):
        base = prose(rng.choice([8, 60, 150, 300]))
        texts += [" ".join(edit(base, rng.randrange(0, 1 + len(base) // 25))) for _ in range(rng.randrange(1, 4))]
    # One hub with many copies of it that are not alike, and unlike texts that share a long passage.
    hub = prose(200)
    texts += [" ".join(hub)] + [" ".join(edit(hub, 3)) for _ in range(60)] + [" ".join(edit(hub, 8)) for _ in range(20)]
    passage = " ".join(prose(60))
    texts += [f"{' '.join(prose(25))} {passage} {' '.join(prose(25))}" for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(7, rows[0][1]), (None, texts[3]), (None, " ".join(prose(30)))]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "COMMON", 1000)
    check(spark, corpus(1))


def test_common_shingles_go_to_the_end_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(op, "COMMON", 1)
    monkeypatch.setattr(op, "LEADERS", 3)
    check(spark, corpus(2))


def test_shingles_are_counted_in_few_bytes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 1 << 40, 200_000, dtype=np.uint64)
    heads[:5] = heads[5:10]
    packed = dict(op._packed(heads))
    back = np.concatenate([op._unpacked(rest).astype(np.uint64) | np.uint64(part) << np.uint64(32) for part, rest in packed.items()])
    assert (back == np.sort(heads)).all() and list(op._packed(heads[:0])) == []
    monkeypatch.setattr(op, "COMMON", 2)
    monkeypatch.setattr(op, "COUNTED", 50)
    frame = spark.createDataFrame(corpus(6), "doc_id bigint, text string").repartition(1)
    sets = {node: found for _, t in corpus(6) for node, _, found in [op._sketch(t, 5)]}
    late, shift = op._common(frame, 5)
    keys, n = np.unique(np.concatenate(list(sets.values())) >> np.uint64(shift), return_counts=True)
    assert list(late) == list(keys[n > 2]) and shift == 24


def test_very_long_texts_and_empty_table(spark):
    rng = random.Random(4)
    long = [str(rng.random()) for _ in range(op.CHUNK + 5000)]
    rows = [(3, " ".join(long)), (2, " ".join(long[:-3000])), (1, " ".join(long[: len(long) // 2])), (9, "short text")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in op.near_groups(frame).collect()} == {1: 1, 2: 2, 3: 2, 9: 9}
    assert {r.doc_id for r in op.keep_one(frame).collect()} == {1, 2, 9}
    assert op.near_groups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("shingle", [3, 5])
def test_sketch_and_fingerprint_agree(spark, shingle):
    rows = corpus(5)[:60]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.fp) for r in op._sketches(frame, shingle).collect()}
    assert got == {(d, (f := op.fingerprint(t, shingle)) - (f >> 63 << 64)) for d, t in rows}
