import random
import re
from collections import Counter

from basalt.llm import quality_rules as op

SCHEMA = "doc_id bigint, text string, n_words int, t string, w string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def run(spark, texts):
    frame = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in op.quality_rules(frame).collect()}


def test_base_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b", "one", "a b", "a b c", "a b c a b c", "x " * 400, "é ü  z\x1c\x85q", "l\nl\n l\nl\n\n \n", "#*$%&|<>!", "a a a", "a a a a", "p q r " * 2 + "s"]
    for _ in range(80):
        vocabulary = [f"W{i}*" if i % 9 == 0 else f"w{i}" for i in range(rng.choice([3, 30, 3000]))]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.choice([5, 60, 300]))))
    got = run(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)


def test_rules_tell_junk_from_prose(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9 + 1))
    good = [prose(rng.randrange(60, 400)) for _ in range(150)]
    symbols = [" ".join(w + rng.choice(["###", "***", "$$$"]) for w in prose(120).split()) for _ in range(15)]
    shouts = [" ".join(w.upper() + "!!" for w in prose(120).split()) for _ in range(15)]
    got = run(spark, good + symbols + shouts)
    assert all(got[i].kept for i in range(150))
    assert not any(got[i].kept for i in range(150, 180))


def test_empty_table(spark):
    assert op.quality_rules(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_em_recovers_accuracies(spark):
    rng = random.Random(7)
    rules = tuple(op.Rule(f"r{i}", "false", "false") for i in range(4))
    counts = Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in (0.95, 0.9, 0.8, 0.7))
        counts[votes] += 1
    patterns = spark.createDataFrame([(*v, n) for v, n in counts.items()], ", ".join(f"v_r{i} int" for i in range(4)) + ", n long")
    prior, model = op.estimate(patterns, rules, rounds=60)
    assert abs(prior - 0.7) < 0.05
    for i, a in enumerate((0.95, 0.9, 0.8, 0.7)):
        good, bad = model[f"r{i}"]["good"], model[f"r{i}"]["bad"]
        assert abs(good[2] / (good[0] + good[2]) - a) < 0.05 and abs(bad[0] / (bad[0] + bad[2]) - a) < 0.07
