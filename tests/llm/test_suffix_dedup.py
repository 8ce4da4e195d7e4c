import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.llm import _common
from basalt.llm import suffix_dedup as op


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def check(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "c", 3) for i, t in zip(ids, texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, tid string, packed int").repartition(3)
    got = op.suffix_dedup(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], bytes(r[4]))
    want = [(i, *b) for i, b in zip(ids, brute(texts), strict=True)]
    assert sorted(map(key, got)) == sorted(map(key, want))
    return got


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefghij klmnop"), (2, "ab"), (3, "aé日🙂 x")])
def test_against_brute_force(spark, seed, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 230, 350, 700)]
    texts = [None, "", "short", text(199), text(200)]
    for _ in range(40):
        parts = [text(rng.randrange(120)) for _ in range(4)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[rng.randrange(60) :] + parts[2])
    for t in list(texts[5:25]):
        at = rng.randrange(len(t))
        texts += [t[:at] + "!" + t[at:], t[:at] + t[at + 1 :]]
    texts += texts[5:9]
    got = check(spark, texts)
    assert sum(r.n_removed for r in got) > 5000


def test_runs_and_overlaps(spark):
    check(spark, ["a" * 200, "b" * 201, "c" * 1000, "xy" * 150, "q" * 199 + "r", "z" * 200 + "y" + "z" * 200, "ab" * 99 + "c"])


def test_repeated_rows_null_ids_and_empty(spark):
    check(spark, ["k" * 50 + str(list(range(100))), "u" * 3, str(list(range(100)))], [None, None, 4])
    t = str(list(range(300)))
    check(spark, [t, t, None, ""], [5, 5, 6, 6])
    assert op.suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 1024)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef ") for _ in range(6000))
    data = [base, base[1500:4500], base[:300] + "?" + base[5500:]]
    batch = op.pa.RecordBatch.from_arrays([op.pa.array([1, 2, 3]), op.pa.array(data)], names=["tid", "text"])
    cover = {}
    for out in op._find_anchors([batch]):
        for tid, packed in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            p, lo, hi = packed >> 16, packed >> 8 & 255, packed & 255
            for d in range(lo, hi + 1):
                assert cover.setdefault((tid, p - d), d) == d
    strings = {}
    for i, d in enumerate(data, 1):
        for q in range(len(d) - 199):
            assert strings.setdefault(d[q : q + 200], cover[i, q]) == cover[i, q]


def test_very_common_gram_is_spread(spark):
    """A passage and a repeated line in most texts: ranges that tasks settle themselves, and runs that meet."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, line = text(400), text(60) + "\n"
    texts = [text(rng.randrange(300)) + passage + text(rng.randrange(300)) for _ in range(30)] + [line * rng.randrange(1, 30) + text(250) for _ in range(30)]
    check(spark, texts)


def test_merge_is_a_sort_with_common_prefixes():
    rng = random.Random(4)
    for _ in range(50):
        runs = []
        for _ in range(rng.randrange(1, 9)):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(12)))
            runs.append((s, op.front_code(s)[0]))
        order, shared = op.merge(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(x for s, _ in runs for x in s)
        assert shared == [op.common(a, b) for a, b in zip([b"", *merged[:-1]], merged)]


def test_a_footer_under_all_texts_fills_no_part(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    footer = text(250)
    texts = [text(rng.randrange(300, 500)) + footer + text(rng.randrange(0, 3)) for _ in range(400)] + [text(300) + footer[20:] for _ in range(30)]
    texts += [t[:250] + text(260) for t in texts[:150]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)

    def largest():
        runs = exchanged = op.exchanged_runs(frame, _common.text_name(frame))[0]
        runs = exchanged.groupBy("part").agg((F.sum(F.coalesce(F.length("lo"), F.lit(0))) + F.sum(F.coalesce(F.length("strings"), F.lit(0))) / 32 / op.HOT_WEIGHT).alias("n"))
        sizes = [float(r.n) for r in runs.collect() if r.n]
        return max(sizes) / (sum(sizes) / len(sizes))

    monkeypatch.setattr(op, "PART", 150)
    before = largest()
    check(spark, texts)
    monkeypatch.setattr(op, "HOT", 40)
    assert largest() < 2 < before
    check(spark, texts)


def test_texts_whose_hashes_clash_are_told_apart(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(30)]
    texts += [texts[3], texts[4][:220] + "x"]
    monkeypatch.setattr(_common, "_hashes", lambda t: (F.xxhash64(t).bitwiseAND(F.lit(3)), F.xxhash64(F.lit(1), t)))
    check(spark, texts)
