"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The rules' accuracies are
not given: expectation-maximisation estimates, for every rule, how often it votes which way on
good and on bad documents, and a document's posterior probability of being good replaces a
conjunction of filters.

Votes take few values, so the corpus is pre-aggregated to a table of vote patterns (at most
3 ** rules rows, whatever the input's size) and every round of EM is one aggregation of that
table. The features are computed once, within the row: no shuffle carries text.

Nulls, empties, ties: a null text counts as an empty one; it has no words, fails the base
checks and is not kept. Rows are judged one by one, so repeated rows and null ids stay as they
are. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._common import WHITE, let, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """bad and good are SQL conditions over the features; neither: the rule abstains."""

    name: str
    bad: str
    good: str


#: Most rules know one defect and abstain where it is absent: the absence of one says little of others. Each defect has two rules or
#: more that can see it, so EM has agreement to learn from.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("prose", "false", "n_symbols < 0.02 * n_words and n_upper < 0.2 * word_chars and n_repeat_words < 0.1 * n_words and n_dup_lines <= 0.3 * n_lines"),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 14 * n_words", "false"),
    Rule("symbols", "n_symbols > 0.15 * n_words", "false"),
    Rule("punctuation", "n_punct > 0.12 * word_chars", "false"),
    Rule("lines", "n_dup_lines > 0.5 * n_lines", "false"),
    Rule("repeats", "n_repeat_words > 0.4 * n_words", "false"),
    Rule("shouting", "n_upper > 0.4 * word_chars", "false"),
    Rule("exclaiming", "n_exclaim > 0.2 * n_words", "false"),
    Rule("digits", "n_digits > 0.3 * word_chars", "false"),
)
#: Characters that any count of single characters looks at: ASCII punctuation, capitals and digits.
COUNTED = r"[^!-/:-@\[-`{-~A-Z0-9]+"


def _only(chars: Column, others: str) -> Column:
    """How many characters are left when runs of others go."""
    return F.length(F.regexp_replace(chars, others, "")).cast("bigint")


def _windows(words: str) -> Column:
    """Hashes of all 3-word windows of an array of word hashes."""
    w = F.col(words)
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def _repeat_words(hashes: Column) -> Column:
    """Words within windows that occur twice or more; near-linear in the text.

    Windows are compared by 64-bit hashes. Only a text with some repeated window sorts them.
    """

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        twice = let(placed, lambda p: F.filter(p, lambda x, j: same(p, x, j - 1) | same(p, x, j + 1)))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum"))
        step = lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(3), i - s["last"])).alias("sum"))
        return F.aggregate(at, start, step, lambda s: s["sum"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered(hashes))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, one row per document, without its text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    split = base.select(
        "doc_id",
        words_of(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"),
        F.regexp_replace("t", COUNTED, "").alias("c"),
    )
    # Each step in a projection of its own: what is used more than once is computed once.
    split = split.withColumn("g", F.transform("w", lambda x: F.xxhash64(x))).withColumn("h", _windows("g"))
    lines, c = F.col("lines"), F.col("c")
    return split.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _only(c, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("h")).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _only(c, "[^A-Z]+").alias("n_upper"),
        _only(c, "[^!]+").alias("n_exclaim"),
        _only(c, "[^0-9]+").alias("n_digits"),
        _only(c, "[A-Z0-9]+").alias("n_punct"),
    )


def _vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0).cast("int").alias(f"v_{rule.name}")


VOTES = (-1, 0, 1)
#: Dirichlet priors of a rule's vote on bad and on good documents, in documents: rules are thought to be right more often than wrong.
PRIOR = {"bad": (10.0, 9.0, 1.0), "good": (0.4, 10.0, 9.6)}
#: No single vote moves the log odds further than this.
MOST = 4.6


def _log_odds(rules: tuple[Rule, ...], prior: float, model: dict[str, dict[str, tuple[float, ...]]]) -> Column:
    """Log odds of good given the votes; model: the probability of each vote on bad and on good documents, by rule."""
    weights = [math.log(prior / (1 - prior))]
    for r in rules:
        bad, none, good = (min(max(math.log(g / b), -MOST), MOST) for g, b in zip(model[r.name]["good"], model[r.name]["bad"], strict=True))
        # A bad vote never speaks for a document, nor a good one against it.
        weights += [min(bad, 0.0), none, max(good, 0.0)]
    # One array literal: the generated code stays the same from round to round and is compiled once.
    table = F.lit(weights)
    total = F.get(table, F.lit(0))
    for i, r in enumerate(rules):
        total = total + F.get(table, F.col(f"v_{r.name}") + 3 * i + 2)
    return total


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 25, tolerance: float = 1e-3) -> tuple[float, dict]:
    """EM over a table of vote patterns (v_<rule> columns and n). Returns the share of good documents and the model.

    Abstaining is an outcome like the votes, so a rule that only ever votes bad can be estimated too. Only a sum for each rule
    and vote reaches the driver in each round.
    """
    shares = lambda w: tuple(x / sum(w) for x in w)
    prior, model = 0.8, {r.name: {k: shares(w) for k, w in PRIOR.items()} for r in rules}
    for _ in range(rounds):
        q, n = 1 / (1 + F.exp(-_log_odds(rules, prior, model))), F.col("n")
        votes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v_{r.name}").alias("v")) for i, r in enumerate(rules)])).alias("e")
        rows = patterns.select(n, q.alias("q"), votes).groupBy("e.i", "e.v").agg(F.sum(n * F.col("q")).alias("good"), F.sum("n").alias("all")).collect()
        if not rows:
            break
        s = {"good": sum(x.good for x in rows if x.i == 0), "all": sum(x["all"] for x in rows if x.i == 0)}
        found = {(x.i, x.v): (x.good, x["all"] - x.good) for x in rows}
        for i, r in enumerate(rules):
            for v in VOTES:
                s[f"good_{r.name}_{v}"], s[f"bad_{r.name}_{v}"] = found.get((i, v), (0.0, 0.0))
        new_prior = min(max((s["good"] + 16) / (s["all"] + 20), 0.1), 0.9)
        new = {r.name: {k: shares([s[f"{k}_{r.name}_{v}"] + w for v, w in zip(VOTES, weights, strict=True)]) for k, weights in PRIOR.items()} for r in rules}
        moved = max([abs(new_prior - prior), *(abs(a - b) for r in rules for k in PRIOR for a, b in zip(new[r.name][k], model[r.name][k], strict=True))])
        prior, model = new_prior, new
        if moved < tolerance:
            break
    return prior, model


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the features, every rule's vote, p_good, base_failed and kept for each row of docs(doc_id, text).

    base_failed: fewer than 50 words, or over half of them in repeated windows; such documents
    are never kept, others are when p_good >= threshold.
    """
    votes = [_vote(r) for r in rules]
    rows = written(features(docs).select("*", *votes), "quality-rules")
    patterns = written(rows.groupBy(*[f"v_{r.name}" for r in rules]).agg(F.count("*").alias("n")), "vote-patterns")
    prior, model = estimate(patterns, rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.withColumn("p_good", 1 / (1 + F.exp(-_log_odds(rules, prior, model))))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )
