"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are the runs of letters and digits of the lower-cased text; shingles are five words (all
words of an item that has fewer). A document leaks an item if some window of the item's length
has a weighted-shingle similarity of at least `SIMILARITY` with it: the sum over shingles of the smaller of the
two counts over the sum of the greater (multiset Jaccard).

1. Shingles of all documents meet the items' shingles. A similar window must share
   `need` of its shingles with the item, so a window can only start where `need` matches lie within
   it; it may be taken to start at a match, since moving right to the first match loses none. This drops no
   similar window, and leaves few windows to fingerprint. A window keeps the items that nominated it.
2. Each window gets a SimHash over its shingles, counted as often as they occur. The 64 bits are cut into BLOCKS = 8
   blocks. Of RADIUS = 23 differing bits some block holds at most 2, and two blocks within 2 bits share a variant among
   themselves and their 1-bit neighbours: so 8 x 9 keys on each side find every pair within the radius. Windows join
   the items that nominated them on (item, block, variant), and the true distance is checked.
3. The exact similarity of window and item decides.

At similarity 0.8 fingerprints differ by 10 bits on average with a deviation of 3, so a similar pair outside the radius is a
matter of 4 deviations. Windows are dealt to tasks by their place, so the probes of few documents use all cores.

DataFrame expressions only. Text is never shuffled in step 1; the items' shingles are broadcast
only after a count shows them to be few, else they join by shuffle.

Nulls, empties, ties: null texts count as empty; documents and items without words match nothing. Among
equally similar windows of a document the first counts. Rows equal in id and text give one result; a null
doc_id is an id of its own. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._common import without, written

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of a fingerprint. Each side emits a block and its 1-bit neighbours, so pairs at 3 * BLOCKS - 1 bits or fewer meet.
BLOCKS = 8
RADIUS = 3 * BLOCKS - 1
#: Item shingles that are broadcast at most (about 32 bytes each).
BROADCAST_ROWS = 500_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def hashed_words(text: Column) -> Column:
    """The 64-bit hashes of a text's words, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: str, width: int) -> Column:
    """Hashes of all runs of width word hashes of the array column `words`."""
    w = F.col(words)
    at = F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))
    return F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))


def simhash(hashes: Column) -> Column:
    """A 64-bit fingerprint: bit b is set if over half of the hashes have it."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
        return (ones * 2 > F.size(hashes)).cast("bigint")

    bits = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), bit)
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of hashes; values are counted only where both arrays repeat some."""
    values = F.array_intersect(a, b)
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    unlike = lambda xs: F.size(F.array_distinct(xs)) == F.size(xs)
    counted = F.aggregate(values, F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)))
    return F.when(unlike(a) | unlike(b), F.size(values)).otherwise(counted)


WIDTH = 64 // BLOCKS


def _block(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _keys(fp: str) -> Column:
    """(block, bits) of every block of a fingerprint and of the block's 1-bit neighbours."""
    flips = [0, *(1 << b for b in range(WIDTH))]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(fp, i).bitwiseXOR(F.lit(f)).alias("bits")) for i in range(BLOCKS) for f in flips]))


def _few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if a count has shown it to have at most `limit` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Leaks (doc_id, item_id, start, distance, similarity): the most similar window for each document and item.

    docs: doc_id, text; items: item_id, text. start counts words from 0.
    """
    known = items.select("item_id", hashed_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    known = known.withColumn("item", F.monotonically_increasing_id())  # rows of one id, or of none, are told apart; fixed by the write
    known = written(known.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE))), "items")
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # at most SHINGLE values
    shape = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), hashed_words(F.col("text")).alias("w")
    )
    found = None
    for width in widths:
        mine = written(
            known.filter(F.col("width") == width).select("item", "item_id", shingles("w", width).alias("s")).withColumn("n", F.size("s")), "item-shingles"
        )
        part = _leaks_of_width(docs, shape, mine, width, similarity)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = F.lit(None)
        return docs.limit(0).select(
            F.col("doc_id").cast("bigint"), empty.cast("bigint").alias("item_id"), empty.cast("bigint").alias("start"), empty.cast("int").alias("distance"), empty.cast("double").alias("similarity")
        )
    best = Window.partitionBy("doc_id", "th", "item_id").orderBy(F.desc("similarity"), "start", "distance")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").select("doc_id", F.col("item_id").cast("bigint"), "start", "distance", "similarity").distinct()


def _leaks_of_width(docs: DataFrame, shape: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    pairs = items.select("item", "n", F.explode(F.array_distinct("s")).alias("h"))
    rows = shape.select("doc_id", "th", shingles("w", width).alias("s"))
    # Outer: from an inner explode Spark infers a filter on the array's size, and would compute the array twice over.
    at = rows.select("doc_id", "th", F.size("s").alias("size"), F.posexplode_outer("s").alias("pos", "h"))
    hits = at.join(_few(pairs), "h").groupBy("doc_id", "th", "size", "item", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    ratio = similarity / (1 + similarity)
    need = F.ceil(F.lit(ratio) * (F.col("n") + F.least("n", "size")) - 1e-9).cast("int")
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    starts = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + need - 1) < p + F.col("n"), F.lit(False)))
    windows = hits.select("doc_id", "th", "n", "item", F.explode(F.array_distinct(F.transform(starts, lambda p: F.least(p, last)))).alias("start"))
    windows = windows.groupBy("doc_id", "th", "n", "start").agg(F.collect_set("item").alias("items"))
    windows = written(windows, "windows")
    # Only documents with such windows are hashed again.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("h"), F.col("text"))
    some = windows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "items")).alias("ws"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    marked = some.join(texts, same).select("doc_id", "th", "ws", hashed_words(F.col("text")).alias("w")).dropDuplicates(["doc_id", "th"])
    cut = marked.select("doc_id", "th", "ws", shingles("w", width).alias("s")).select("doc_id", "th", "s", F.explode("ws").alias("e"))
    cut = cut.select("doc_id", "th", F.col("e.start").alias("start"), F.slice("s", F.col("e.start") + 1, F.col("e.n")).alias("ws"), F.col("e.items").alias("items"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(cut.repartition(tasks, "doc_id", "start").withColumn("fp", simhash(F.col("ws"))), "window-fingerprints")
    near = candidates(cut, items).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("distance") <= RADIUS)
    scored = near.withColumn("both", overlap(F.col("ws"), F.col("s")))
    scored = scored.withColumn("similarity", F.col("both") / (F.size("ws") + F.size("s") - F.col("both")))
    return scored.filter(F.col("similarity") >= similarity).select("doc_id", "th", "item_id", F.col("start").cast("bigint").alias("start"), "distance", "similarity")


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """What the index finds: windows (doc_id, th, start, ws, fp, items) with the s and item_fp of those of their items that share a key with them."""
    index = items.withColumn("fp", simhash(F.col("s"))).select("item", "item_id", "s", F.col("fp").alias("item_fp"), _keys("fp").alias("k"))
    index = index.select("item", "item_id", "s", "item_fp", "k.block", "k.bits")
    probes = windows.select("doc_id", "th", "start", "ws", "fp", F.explode("items").alias("item"))
    probes = probes.select("doc_id", "th", "start", "ws", "fp", "item", _keys("fp").alias("k")).select("doc_id", "th", "start", "ws", "fp", "item", "k.block", "k.bits")
    met = probes.join(_few(index, BROADCAST_ROWS // 4), ["item", "block", "bits"])
    # A pair that meets several times counts at its first close block, and there at its least variant.
    close = lambda i: F.bit_count(_block("fp", i).bitwiseXOR(_block("item_fp", i))) <= 2
    first = F.lit(-1)
    for i in reversed(range(BLOCKS)):
        first = F.when(close(i), i).otherwise(first)
    met = met.filter(F.col("block") == first)
    own = F.element_at(F.array(*[_block("fp", i) for i in range(BLOCKS)]), F.col("block") + 1)
    other = F.element_at(F.array(*[_block("item_fp", i) for i in range(BLOCKS)]), F.col("block") + 1)
    flips = F.lit([0, *(1 << b for b in range(WIDTH))])
    least = F.array_min(F.array_intersect(F.transform(flips, lambda f: own.bitwiseXOR(f)), F.transform(flips, lambda f: other.bitwiseXOR(f))))
    return met.filter(F.col("bits") == least).drop("block", "bits")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose id leaks no item; rows with a null id stay."""
    bad = find_leaks(docs, items).filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return without(docs, bad)
