"""Line dedup by a log-template tree of fixed depth.

Lines are parsed down a tree: token count, then the first DEPTH tokens, tokens with digits
being variable fields from the start. Within a leaf a token that fewer than `min_docs`
documents have at its position is a variable field too, so lines that differ only there get one template. A
template that at least `min_docs` documents hold, and of whose tokens a share of `constant` is fixed, is
recurring (in lines of more than DEPTH + 1 tokens one of them beyond the leaf's own; the queries ask for HALF), and its lines are dropped from all documents. Lines of fewer than `min_tokens` tokens stay.
A line of more than `long_tokens` tokens is proof by itself: held word for word by `long_docs` texts, though
by fewer than make it recurring, it stays only in the row of the least id among its holders.
Recurring lines go in every document, whatever is left of it. Of the texts that lose more than `max_share` of their words to them, which may be
copies of each other, the row of the least id keeps a template's lines, so that no such text is lost altogether.

Documents count by their text (told by 128 bits, see text_name): copies of a text are one document, and so are all lines of one text that have
the same token at a place or the same template. Counts are exact and over all documents. The tree is an
aggregation on leaf, position and token of distinct lines with their counts, so a very common line or
leaf is one row per task, and no leaf is gathered in one place; what texts with several lines of one leaf add to these
counts more than once is counted apart, from those texts' lines only, and taken off. Lines travel
as hashes; only one example of each distinct line in a leaf with enough documents is read again.

Nulls, empties, ties: a null text counts as empty and stays null; blank lines stay. Every row gives one row,
repeated rows and null ids too. Other columns pass through, whatever their names, but n_lines, n_dropped and text are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._common import text_name, written

DEPTH = 3
MIN_DOCS = 10
MIN_TOKENS = 3
CONSTANT = 0.8
#: The share of fixed tokens that op3 and the pipeline ask for: lines with several fields recur too.
HALF = 0.5
MAX_SHARE = 0.5
LONG_TOKENS = 50
LONG_DOCS = 2
FIELD = "<*>"
DIGIT = re.compile(r"\d")


def parse(line: str) -> list[str]:
    """The tokens of a line, those with digits as variable fields."""
    tokens = line.split()
    return [FIELD if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def leaf_of(tokens: list[str]) -> int:
    return _signed(xxhash.xxh64_intdigest("\x00".join([str(len(tokens)), *tokens[:DEPTH]])))


def line_hash(tokens: list[str]) -> int:
    return _signed(xxhash.xxh64_intdigest(" ".join(tokens)))


def _lines(docs: DataFrame, name: Column, min_tokens: int, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """th (name of the text), line (number), words, leaf and gen (hash of the parsed line) of every distinct text.

    all counts the words of the text; exact is the hash of a long line's own tokens, null for others; several tells that the text has
    another parsed line in the same leaf; first is the least id of the text's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for th, text, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py()
                n = len(whole.split())
                found, gens = [], {}
                for i, line in enumerate(whole.split("\n")):
                    tokens = parse(line)
                    if len(tokens) >= min_tokens:
                        exact = line_hash(line.split()) if len(tokens) > long_tokens else None
                        leaf, gen = leaf_of(tokens), line_hash(tokens)
                        gens.setdefault(leaf, set()).add(gen)
                        found.append((th, i, len(tokens), n, leaf, gen, exact, first))
                for row in found:
                    for column, value in zip(out, (*row, len(gens[row[4]]) > 1), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names = ["th", "line", "words", "all", "leaf", "gen", "exact", "first", "several"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    rows = docs.filter("text is not null").select(name.alias("th"), "text", F.col("doc_id").cast("bigint").alias("first"))
    parsed = rows.mapInArrow(run, "th bigint, line int, words int, all int, leaf bigint, gen bigint, exact bigint, first bigint, several boolean")
    return parsed.groupBy("th", "line", "words", "all", "leaf", "gen", "exact", "several").agg(F.min("first").alias("first"))


def _examples(docs: DataFrame, name: Column, wanted: DataFrame) -> DataFrame:
    """gen and tokens of the lines wanted(th, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gens, tokens = [], []
            for text, numbers in zip(batch.column(0), batch.column(1), strict=True):
                lines = text.as_py().split("\n")
                for i in set(numbers.as_py()):
                    tokens.append(parse(lines[i]))
                    gens.append(line_hash(tokens[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(gens, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], names=["gen", "tokens"])

    rows = docs.filter("text is not null").select(name.alias("of"), "doc_id", "text")
    # One row of each text is read, whatever its copies: that of the least id.
    firsts = rows.groupBy(F.col("of").alias("th")).agg(F.min("doc_id").alias("first"))
    lists = wanted.groupBy("th").agg(F.collect_list("line").alias("lines")).join(firsts, "th")
    # The same plan at every size: texts and lists meet by a shuffle.
    same = (F.col("of") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("first"))
    return rows.join(lists.hint("merge"), same).select("text", "lines").mapInArrow(run, "gen bigint, tokens array<string>").dropDuplicates(["gen"])


def recurring(docs: DataFrame, name: Column, lines: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """gen of the lines whose template recurs, and the hash of that template."""
    gens = lines.groupBy("leaf", "gen", "th").agg(F.min("line").alias("line")).groupBy("leaf", "gen").agg(F.count("*").alias("docs"), F.min(F.struct("th", "line")).alias("at"))
    gens = written(gens, "lines-by-hash")
    leaves = gens.groupBy("leaf").agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs).select("leaf")
    live = written(gens.join(leaves, "leaf"), "lines-in-leaves")
    tokens = _examples(docs, name, live.select("at.*"))
    parts = live.join(tokens, "gen").select("leaf", "gen", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    parts = written(parts, "line-tokens")
    several = written(lines.filter("several").select("gen", "th").distinct(), "lines-of-one-leaf")
    # Sums over lines are upper bounds of the documents, so what they rule out needs no second look.
    place = ["leaf", "pos", "token"]
    bound = parts.filter(F.col("token") != FIELD).groupBy(*place).agg(F.sum("docs").alias("sum")).filter(F.col("sum") >= min_docs)
    fixed = _documents(bound, parts.filter(F.col("token") != FIELD).select("gen", *place), several, place).filter(F.col("sum") >= min_docs)
    shaped = parts.join(fixed, place, "left").withColumn("token", F.when(F.col("sum").isNull(), FIELD).otherwise(F.col("token")))
    # A template is told by its leaf and the sum of its fixed tokens' placed hashes.
    placed = F.xxhash64("pos", "token").cast("decimal(38,0)")
    is_fixed = F.col("token") != FIELD
    templates = shaped.groupBy("leaf", "gen", "n", "docs").agg(
        F.coalesce(F.sum(F.when(is_fixed, placed)), F.lit(0)).alias("t"),
        F.count(F.when(is_fixed, 1)).alias("fixed"),
        F.count(F.when(is_fixed & (F.col("pos") >= DEPTH), 1)).alias("beyond"),
    )
    told = (F.col("n") <= DEPTH + 1) | (F.col("beyond") > 0)  # the leaf alone does not tell a long line
    templates = written(templates.filter((F.col("fixed") >= constant * F.col("n")) & told), "templates")
    bound = templates.groupBy("leaf", "t").agg(F.sum("docs").alias("sum")).filter(F.col("sum") >= min_docs)
    common = _documents(bound, templates.select("gen", "leaf", "t"), several, ["leaf", "t"]).filter(F.col("sum") >= min_docs)
    return templates.join(common, ["leaf", "t"]).select("gen", F.xxhash64("leaf", "t").alias("template")).distinct()


def _documents(bound: DataFrame, members: DataFrame, several: DataFrame, key: list[str]) -> DataFrame:
    """bound (key, sum), sum less what texts with more than one of a key's lines add beyond one.

    members: gen and key of all lines; several: gen and th of the lines of texts with more than one line in a leaf.
    """
    of_text = members.join(bound.select(*key), key).join(several, "gen").groupBy(*key, "th").agg((F.count("*") - 1).alias("more"))
    more = of_text.filter("more > 0").groupBy(*key).agg(F.sum("more").alias("more"))
    return bound.join(more, key, "left").select(*key, (F.col("sum") - F.coalesce("more", F.lit(0))).alias("sum"))


def repeated(lines: DataFrame, gens: DataFrame, long_docs: int = LONG_DOCS) -> DataFrame:
    """Long lines of at least long_docs texts that are not among gens: th, line, words, first, and template, here the line itself."""
    long = lines.filter("exact is not null").select("th", "line", "words", "gen", "exact", "first")
    held = long.select("exact", "th").distinct().groupBy("exact").agg(F.count("*").alias("docs")).filter(F.col("docs") >= long_docs).select("exact")
    return long.join(held, "exact").join(gens.select("gen"), "gen", "left_anti").select("th", "line", "words", "first", F.col("exact").alias("template"))


def line_dedup(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    constant: float = CONSTANT,
    max_share: float = MAX_SHARE,
    long_tokens: int = LONG_TOKENS,
    long_docs: int = LONG_DOCS,
) -> DataFrame:
    """docs (doc_id, text, …) with text without its recurring lines, and n_lines and n_dropped (both bigint)."""
    name = text_name(docs)
    lines = written(_lines(docs, name, min_tokens, long_tokens), "lines")
    gens = written(recurring(docs, name, lines, min_docs, constant), "recurring-lines")
    common = lines.join(gens, "gen").select("th", "line", "words", "all", "first", "template")
    most = common.groupBy("th", "all").agg(F.sum("words").alias("lost")).filter(F.col("lost") > max_share * F.col("all")).select("th", F.lit(True).alias("shared"))
    common = common.join(most, "th", "left").select("th", "line", "first", "template", F.coalesce("shared", F.lit(False)).alias("shared"))
    few = repeated(lines, gens, long_docs).select("th", "line", "first", "template", F.lit(True).alias("shared"))
    lost = written(common.unionByName(few), "lost-lines")
    holders = lost.filter("shared").groupBy("template").agg(F.min(F.struct("first", "th")).alias("at")).select("template", "at.th", F.lit(True).alias("holder"))
    hit = lost.join(holders, ["template", "th"], "left").groupBy("th").agg(
        F.collect_list("line").alias("_drop"), F.collect_list(F.when(F.col("holder"), F.col("line"))).alias("_held"), F.min("first").alias("_first")
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    hit = written(hit, "dropped-lines")
    # The row travels as one struct, so that no name of its columns can meet one made here.
    rows = docs.select(F.struct(*columns).alias("row"), name.alias("of"))
    joined = rows.join(hit.hint("merge"), F.col("of") == F.col("th"), "left")
    # Of the holder's copies too, only the row of the least id keeps the lines.
    held = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("_first"))
    drop = F.coalesce(F.when(held, F.array_except("_drop", "_held")).otherwise(F.col("_drop")), F.array().cast("array<int>"))
    joined = joined.select("row", drop.alias("drop"), F.split("row.text", "\n").alias("all"))
    left = F.filter("all", lambda x, i: ~F.array_contains("drop", i))
    text = F.when(F.size("drop") == 0, F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in columns],
        F.coalesce(F.size("all"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("drop").cast("bigint").alias("n_dropped"),
    )
