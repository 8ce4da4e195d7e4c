import random
from collections import defaultdict

import corpus_pipeline
from basalt.llm import line_dedup as op
from basalt.llm.queries import QUERIES


def brute(texts, min_docs=10, min_tokens=3, constant=0.8, max_share=0.5):
    """The tree of one process: sets of texts by leaf, place and token, and by template."""
    lines = defaultdict(set)
    for t in {t for t in texts if t is not None}:
        for line in t.split("\n"):
            tokens = tuple(op.parse(line))
            if len(tokens) >= min_tokens:
                lines[tokens].add(t)
    support = defaultdict(set)
    for tokens, docs in lines.items():
        for i, w in enumerate(tokens):
            support[len(tokens), tokens[:3], i, w] |= docs
    template = {k: tuple(w if w != op.FIELD and len(support[len(k), k[:3], i, w]) >= min_docs else op.FIELD for i, w in enumerate(k)) for k in lines}
    held = defaultdict(set)
    for k, docs in lines.items():
        if sum(w != op.FIELD for w in template[k]) >= constant * len(k):
            held[len(k), k[:3], template[k]] |= docs
    bad = {k for k in lines if len(held[len(k), k[:3], template[k]]) >= min_docs}
    out = []
    for t in texts:
        parts = [] if t is None else t.split("\n")
        drop = [i for i, x in enumerate(parts) if tuple(op.parse(x)) in bad]
        assert sum(len(parts[i].split()) for i in drop) <= max_share * max(len((t or "").split()), 1), "this brute force has no holders"
        out.append((t if t is None else "\n".join(x for i, x in enumerate(parts) if i not in drop), len(drop)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    texts = [None, "", "\n\n", "All rights reserved here today"]
    for i in range(60):
        body = [" ".join(word() + str(rng.randrange(3)) * (rng.random() < 0.1) for _ in range(rng.randrange(2, 12))) for _ in range(8)]
        if i % 2:
            body.insert(rng.randrange(8), f"Posted by user{i} at 10:{i} on the forum board")
        if i % 3 == 0:
            body.insert(0, f"Copyright notice all rights are reserved by {word()} press office in this long line of text")
        texts.append("\n".join(body))
    stall = "\n".join(f"The market stall sells fresh {chr(97 + j)}{'berry' * (j % 3 + 1)} every single sunny morning in town" for j in range(14))
    texts += [texts[10]] * 12 + [stall, stall + "\nand one line of its own here"]
    frame = spark.createDataFrame([(i, t, 7, "s") for i, t in enumerate(texts)] + [(None, texts[8], 7, "s")], "doc_id bigint, text string, n_lines int, source string")
    got = op.line_dedup(frame).collect()
    want = brute(texts)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 1
    for i, (text, dropped) in enumerate(want):
        assert (by_id[i].text, by_id[i].n_dropped) == (text, dropped), i
    assert sum(d for _, d in want) > 25 and by_id[None].text == want[8][0] and by_id[3].source == "s"


def test_lines_of_one_document_do_not_recur(spark):
    stall = "\n".join(f"The market stall sells fresh {c} every single sunny morning in town" for c in "apples pears plums figs dates limes kiwis nuts leeks kale beets corn".split())
    texts = [stall, "Nothing of the kind stands in here", "Nor is there any such thing in this one", stall]
    got = op.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), constant=op.HALF).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts)) and not any(r.n_dropped for r in got)


def test_clashing_names_and_long_texts(spark):
    long = "\n".join(f"line number {i} of a very long text indeed" + " word" * 30 for i in range(20_000))
    rows = [(i, f"own{chr(97 + i)}\nThe same footer stands under all pages here", 1, 2, 3, 4, 5, 6, 7) for i in range(12)] + [(12, long, 1, 2, 3, 4, 5, 6, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _hash int, th int, _drop int, row int, `all` int, first int, gen int")
    got = {r.doc_id: r for r in op.line_dedup(frame).collect()}
    assert len(got) == 13 and got[12].text == long and got[12].n_lines == 20_000
    assert [got[i].n_dropped for i in range(12)] == [0] + [1] * 11 and all((r._hash, r.th, r._drop, r.row, r["all"], r.first, r.gen) == tuple(range(1, 8)) for r in got.values())


def test_empty_table(spark):
    assert op.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_line_of_few_texts_stays_once(spark):
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [f"{passage}\n" + " ".join(f"own{chr(97 + i)}{chr(97 + j)}" for j in range(12)) for i in range(5)]
    short = " ".join(passage.split()[:40])
    texts += [texts[1]] * 3 + [texts[0]] * 2 + [short + "\nfirst text", short + "\nsecond text"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in op.line_dedup(frame).collect()}
    assert len(got) == len(texts)
    assert [i for i, r in sorted(got.items()) if passage in r.text] == [0]
    assert [got[i].n_dropped for i in range(len(texts))] == [0] + [1] * 9 + [0, 0]
    assert all(got[i].text == (t if i in (0, 10, 11) else t.split("\n")[1]) for i, t in enumerate(texts))


def test_recurring_lines_go_whatever_their_share(spark):
    licence = "Licensed under the terms of our own licence"
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = [f"Own{chr(97 + i)} words" for i in range(14)]
    texts = [f"{x}\n{licence}" for x in own] + [f"{x} of page\n{passage}" for x in own] + [licence] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in op.line_dedup(frame).collect()}
    assert len(got) == len(texts)
    assert [i for i, t in sorted(got.items()) if licence in t] == [0]
    assert [i for i, t in sorted(got.items()) if passage in t] == [14]
    assert all(got[i] == texts[i].split("\n")[0] for i in range(28) if i not in (0, 14)) and got[28] == got[30] == ""


def test_queries_drop_lines_with_several_fields(spark, tmp_path):
    word = lambda i, j: f"w{chr(97 + i)}{chr(97 + j)}"
    own = [" ".join(word(i, j) for j in range(20)) for i in range(16)]
    lines = lambda i: [f"Posted by user{i} at 10:{i} on the forum board", f"Page {i} of {i + 20}", "One of the " + " ".join(word(i, j + 3) for j in range(3))]
    texts = ["\n".join([x, *lines(i)]) for i, x in enumerate(own)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert got == {i: f"{x}\n{lines(i)[2]}" for i, x in enumerate(own)}
    assert {r.n_dropped for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()} == {2}
