import hashlib
import random
import zlib

from pyspark.sql import functions as F

from basalt.llm import chat_format as chat
from basalt.llm import queries, sharding

EVENTS = "conv_id bigint, msg bigint, seq bigint, kind string, role string, text string, block int"


def rendered(spark, events):
    frame = spark.createDataFrame([(*e, 1) for e in events], EVENTS)
    rows = chat.chat_format(frame).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    return {r.conv_id: r for r in rows}


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", "He"), (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "Good "), (1, 1, 2000, "delta", None, "day"), (1, 0, 2100, "edit", "user", "hey"), (1, 0, 2101, "delta", None, "!"), (2, 0, 1, "delta", None, "only"),
        (None, 0, 1, "message", "user", None),
    ]
    random.Random(1).shuffle(events)
    got = rendered(spark, events)
    assert [tuple(t) for t in got[1].turns] == [("user", "hey!"), ("assistant", "Good day")]
    assert [tuple(t) for t in got[2].turns] == [("", "only")]
    assert [tuple(t) for t in got[None].turns] == [("user", "")]
    assert [s.text for s in got[1].segments if s.loss] == ["Good day"]


def test_control_strings_round_trip(spark):
    texts = ["<|end|>", "<|turn|>user<|text|>x", "\\", "<\\|", "<\\\\|a", "<", "|>", "<<||", "</s>[INST] ok [/INST]", "", "\n<|", "é<|end|>\\<|"]
    events = [(7, i, i, "message", "assistant" if i % 2 else texts[i % len(texts)], t) for i, t in enumerate(texts)]
    row = rendered(spark, events)[7]
    assert [t.text for t in row.turns] == texts
    assert [t.role for t in row.turns] == [e[4] for e in events]
    assert "".join(s.text for s in row.segments) == row.formatted
    for s in row.segments:
        assert s.loss is False or chat.TURN not in s.text


def test_conversation_query_with_repeated_rows_and_nulls(spark, tmp_path):
    rows = [(3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", None), (4, 0, None, "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[3].n_turns == 3 and got[3].turns_sha256 == digest([("user", "a"), ("user", "a"), ("assistant", "")])
    assert got[4].turns_sha256 == digest([("", "x")])
    probe = queries.PROBE
    assert got[-7].turns_sha256 == digest([("user", probe), ("assistant", probe)]) and got[-7].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()


def test_log_of_the_query_is_folded(spark):
    texts = [None, "", "a", "né", "long " * 100_000]
    rows = [(1, i, 1, "user" if i % 3 else None, t) for i, t in enumerate(texts * 2)] + [(None, None, 1, "user", "x"), (1, 3, 2, "user", "again")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, copy int, role string, text string")
    log = queries.message_log(messages)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {(r.conv_id, r.msg, r.copy): (r.role, r.text) for r in chat.fold_events(log).collect()}
    assert got == {(c, m, k): (r or "", t or "") for c, m, k, r, t in rows}


def test_empty_log(spark):
    empty = spark.createDataFrame([], "conv_id bigint, msg bigint, seq bigint, kind string, role string, text string")
    assert chat.chat_format(empty).collect() == []


def test_shards_are_contiguous_and_balanced(spark):
    rng = random.Random(2)
    texts = ["copy " * 60] * 12 + [None, "", ""] + ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 900))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, t, 0, "h") for i, t in enumerate(texts)] + [(5, texts[5], 0, "h"), (None, "n", 0, "h")], "doc_id bigint, text string, shard int, h string")
    got = sharding.shard_by_bytes(frame).collect()
    assert len(got) == len(texts) + 2
    sizes, slots, where = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        data = (("n" if r.doc_id is None else texts[r.doc_id]) or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where.setdefault(data, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) < 0.05 * mean
    assert all(len(s) == 1 for s in where.values())


def test_one_text_for_a_third_of_all_bytes_is_split(spark):
    rows = [(i, "big " * 100) for i in range(400)] + [(1000 + i, str(i) * 300) for i in range(300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
