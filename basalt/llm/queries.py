"""The queries opN_<name>: every operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm import chat_format, decontaminate, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash_dedup, suffix_dedup, toxicity
from basalt.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


#: Control strings of well-known templates inside both texts of a made conversation.
PROBE = "</s>[INST] ok [/INST]"
#: Sequence numbers that one message takes in the log.
STRIDE = 8


def message_log(messages: DataFrame) -> DataFrame:
    """The event log (see chat_format.fold_events) whose fold gives messages (conv_id, turn, copy, role, text) back.

    A message of an even turn is streamed, regenerated and streamed anew in two deltas; one of an odd turn starts with its second
    half, and an edit puts the whole text in its place.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.length(text).cast("int").bitwiseAND(F.lit(-2)) / 2
    first, rest = F.substring(text, F.lit(1), half.cast("int")), F.substring(text, half.cast("int") + 1, F.length(text))
    event = lambda i, kind, role, part: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), role.alias("role"), part.alias("text"))
    none = F.lit(None).cast("string")
    streamed = F.array(event(0, "message", F.col("role"), first), event(1, "delta", none, F.lit("…")), event(2, "regenerate", none, none), event(3, "delta", none, first), event(4, "delta", none, rest))
    edited = F.array(event(0, "message", F.col("role"), rest), event(1, "delta", none, F.lit("…")), event(2, "edit", none, text))
    events = F.when(F.coalesce(F.col("turn"), F.lit(0)) % 2 == 0, streamed).otherwise(edited)
    rows = messages.select("conv_id", F.col("turn").alias("msg"), "copy", F.explode(events).alias("e"))
    seq = F.coalesce(F.col("msg"), F.lit(0)) * STRIDE + F.col("e.i")
    return rows.select("conv_id", "msg", seq.alias("seq"), "copy", "e.kind", "e.role", "e.text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("m"),
    )
    rows = rows.unionByName(probe.select("conv_id", "m.turn", "m.role", F.lit(PROBE).alias("text")))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = message_log(rows.withColumn("copy", copy))
    done = chat_format.chat_format(events).withColumn("turns", chat_format.read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc as (
  select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + length('<|turn|><|text|><|end|>') as chars from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from esc group by conv_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), constant=line_dedup.HALF)
    return rows.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.octet_length("text").cast("bigint").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
}

#: The same law from window sums over the whole order; CRC-32 by its table, a byte at a time.
OP4_SQL = """
WITH crc(b, c) AS (
  SELECT range, list_reduce([range] || [0, 1, 2, 3, 4, 5, 6, 7], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM range(256)
), tab AS (SELECT list(c ORDER BY b) AS t FROM crc),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(text), '..'), lambda p: ('0x' || p)::BIGINT),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, tab
),
p AS (
  SELECT *, (sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
    row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, sum(size) OVER ()::BIGINT AS total
  FROM s
),
o AS (SELECT *, least((2 * start + size) * 8 // (2 * total), 7) AS own FROM p),
g AS (
  SELECT h, least((2 * min(start) + sum(size)::BIGINT) * 8 // (2 * any_value(total)), 7) AS grouped
  FROM o GROUP BY h HAVING min(own) < max(own) AND sum(size) * 8 <= 0.02 * any_value(total)
),
f AS (SELECT o.*, coalesce(grouped, own)::INTEGER AS shard FROM o LEFT JOIN g USING (h))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM f
"""
ORACLE_SQL["op4_sharding"] = OP4_SQL

#: Every 200-byte string of every text (as hex, cut into pieces first) by its MD5; what repeats, as merged runs, and the bytes between them.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT *, length(h) // 2 AS n FROM d),
c AS (SELECT r, n, b, substring(h, 2 * b + 1, 2398) AS p FROM (SELECT *, unnest(range(0, n - 199, 1000)) AS b FROM t WHERE n >= 200)),
s AS (SELECT r, b + i AS start, md5(substring(p, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(1000, n - 199 - b))) AS i FROM c)),
m AS (SELECT r, start FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY r ORDER BY start) <= 200 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f),
u AS (SELECT r, run, min(start) AS a, max(start) + 200 AS z FROM g GROUP BY r, run),
e AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM u UNION ALL SELECT r, coalesce(max(u.z), 0), any_value(n) FROM t LEFT JOIN u USING (r) GROUP BY r),
k AS (SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS left_over FROM e JOIN t USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(left_over) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM u WHERE u.r = t.r) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM t JOIN k USING (r)
"""
ORACLE_SQL["op10_suffix_dedup"] = OP10_SQL
