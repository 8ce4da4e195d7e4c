import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from basalt.llm import quality_classifier as quality
from basalt.llm import toxicity

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_frames(spark):
    rows, labels = [(5000, None), (5001, ""), (None, "idiotic")], [(5000, None), (None, 1)]
    for i in range(600):
        bad = i % 5 == 0
        w = prose(60).split()
        if bad:
            w.insert(RNG.randrange(60), RNG.choice(["moron", "idiot", "scumbag"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_on_held_out_rows(toxic_frames):
    got = toxicity.toxicity(*toxic_frames).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in got if r.held_out} >= {r.doc_id for r in held} and len(held) > 150
    caught = sum(r.predicted for r in held if r.doc_id % 5 == 0)
    assert caught >= 0.9 * sum(r.doc_id % 5 == 0 for r in held) and not any(r.predicted for r in held if r.doc_id % 5)


def test_held_out_labels_are_not_read(toxic_frames):
    docs, labels = toxic_frames
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert sorted(map(key, toxicity.toxicity(docs, labels).collect())) == sorted(map(key, toxicity.toxicity(docs, turned).collect()))


def test_toxicity_without_labels(toxic_frames):
    docs, labels = toxic_frames
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def site_rows(spark):
    rows, labels = [], []
    for i in range(600):
        site = ["https://Good.example/blog/a", "http://bad.example/spam", "good.example/forum", None, "src1"][i % 5]
        junk = RNG.random() < (0.9 if i % 5 == 1 else 0.05)
        text = " ".join(w + "###" for w in prose(60).split()) if junk else prose(80)
        rows.append((i, text, site, int(not junk)))
        if i % 3 == 0:
            labels.append((i, int(not junk)))
    docs = spark.createDataFrame(rows + [(7000, None, "rare.example", 0), (None, prose(80), "src1", 1)], "doc_id bigint, text string, source string, host int")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_shrinks_sites_and_tells_documents_apart(spark):
    docs, labels = site_rows(spark)
    got = {r.doc_id: r for r in quality.quality_classifier(docs, labels).collect()}
    truth = {r.doc_id: r.host for r in docs.collect()}
    assert len(got) == 602
    assert sum(got[i].kept == bool(truth[i]) for i in range(600)) >= 595
    assert got[0].host == "good.example" and got[0].path == "blog" and got[1].path == "spam" and got[3].host == ""
    assert got[1].p_host < 0.4 < 0.8 < got[0].p_host
    mean = sum(r.p_doc for r in got.values()) / len(got)
    assert abs(got[7000].p_host - mean) < abs(got[7000].p_doc - mean)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1


def test_quality_against_brute_force(spark):
    """The grouped posteriors in plain Python, from the documents' own evidence as the operator gives it."""
    docs, labels = site_rows(spark)
    got = quality.quality_classifier(docs, labels).collect()
    truth = {r.doc_id: r.host for r in docs.collect()}
    y = [truth[i] for i in range(0, 600, 3)]
    base = math.log(sum(y) / (len(y) - sum(y)))
    logit = lambda p: math.log(p / (1 - p))

    def moments(groups):
        n = sum(n for n, _, _ in groups)
        chance = sum(n * c * (1 - c) for n, _, c in groups) / n
        between = sum(n * (g / n - c) ** 2 for n, g, c in groups) / n - chance * len(groups) / n
        return min(max(chance / max(between, 1e-6) - 1, 5.0), 1e5)

    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(r.p_doc)
        paths[r.host, r.path].append(r.p_doc)
    share = (sum(r.p_doc for r in got) + 1) / (len(got) + 2)
    a = moments([(len(v), sum(v), share) for v in hosts.values()])
    b = moments([(len(v), sum(v), (sum(hosts[h]) + a * share) / (len(hosts[h]) + a)) for (h, _), v in paths.items()])
    for r in got:
        h, p = hosts[r.host], paths[r.host, r.path]
        p_host = (sum(h) - r.p_doc + a * share) / (len(h) - 1 + a)
        p_path = (sum(p) - r.p_doc + b * p_host) / (len(p) - 1 + b)
        odds = logit(p_path) + max(-8, min(8, logit(r.p_doc) - base))
        assert abs(r.p_host - p_host) < 1e-9 and abs(r.p_path - p_path) < 1e-9 and abs(r.p_quality - 1 / (1 + math.exp(-odds))) < 1e-6


def test_rows_of_one_id_are_judged_one_by_one(spark):
    docs, labels = site_rows(spark)
    junk = " ".join(w + "###" for w in prose(60).split())
    twice = docs.union(spark.createDataFrame([(0, junk, "good.example/forum", 0), (None, junk, "http://bad.example/spam", 0), (9000, "word " * 200_000, None, 0)], docs.schema))
    kept = quality.keep_good(twice, labels, max_rows=50)
    assert [r.text == junk for r in kept.filter("doc_id = 0").collect()] == [False] and kept.filter("doc_id is null").count() == 1


def test_quality_without_labels_or_rows(spark):
    docs, labels = site_rows(spark)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_classifier(docs.limit(0), labels).collect() == []


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(3)
    rows = [(np.unique([rng.randrange(60) for _ in range(rng.randrange(1, 12))]).astype(np.int32), rng.randrange(2)) for _ in range(80)]
    bias, at, weights = toxicity.ftrl(rows, epochs=3, alpha=0.7, beta=0.9, l1=0.4, l2=0.1)
    seen = defaultdict(int)
    for f, _ in rows:
        for i in f.tolist():
            seen[i] += 1
    z, n = defaultdict(float), defaultdict(float)
    rate = sum(y for _, y in rows) / len(rows)
    start, shift, shift_n = math.log(rate / (1 - rate)), 0.0, 1.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.4 else (math.copysign(0.4, z[i]) - z[i]) / ((0.9 + math.sqrt(n[i])) / 0.7 + 0.1)

    for _ in range(3):
        for f, y in rows:
            known = [i for i in f.tolist() if seen[i] > 1]
            w = {i: weight(i) for i in known}
            g = 1 / (1 + math.exp(-(start + shift + sum(w.values())))) - y
            for i in known:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
                z[i] += g - sigma * w[i]
                n[i] += g * g
            shift_n += g * g
            shift -= 0.05 * g / math.sqrt(shift_n)
    assert abs(bias - start - shift) < 1e-9
    assert {i: round(w, 9) for i, w in zip(at.tolist(), weights.tolist(), strict=True)} == {i: round(weight(i), 9) for i in z if weight(i) != 0}


def test_very_long_text_scores_as_its_parts_say(spark):
    words = [f"w{i % 5000}" for i in range(toxicity.CHUNK + 3000)]
    hasher = toxicity.Hasher()
    whole = set(hasher.features(" ".join(words)).tolist())
    parts = set()
    for i in range(0, len(words), 1000):
        parts |= set(hasher.features(" ".join(words[i : i + 1002])).tolist())
    assert whole == parts
