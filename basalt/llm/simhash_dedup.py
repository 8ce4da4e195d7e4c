"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint has a bit set where over half of its shingles' XXH64 values (seed 42) have it.
Two fingerprints link at `RADIUS` = 3 or fewer differing bits. Balls of half that radius
(1, rounded down) meet only up to distance 2, so the odd bit is taken out first: the word is
cut into three blocks and each block is blanked in turn. Of at most 3 differing bits some block
holds at least one, and with that block blanked at most 2 remain, so the two balls of radius 1 in the
other bits share a variant. Every distinct fingerprint thus emits 3 blanked words and their
1-bit neighbours, 131 keys in all, where full balls of radius 2 would take 2081. Rows meet on the key;
the true distance is verified there, and a key's rows give a spanning forest of their links, never
all pairs. A large group costs little: each step compares one member with those not yet reached.

Equal fingerprints are one row before anything is emitted, so copies do not multiply. Components come from
alternating large-star and small-star rounds over distinct edges, each round a written table; nothing
but counts and checksums reaches the driver.

keep_one() leaves one row of each group of texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.
Such pairs differ by 10 bits on average, where no ball of half the radius can be enumerated, so balls find the closest of
them, and what they miss is found exactly by another method: near_groups() joins texts on the rare end of their shingles.
Of two sets of m and n shingles at similarity t, put in any one order, the first m - ceil(t m) + 1 and
n - ceil(t n) + 1 must meet. The order is by hash, with shingles that many texts share at the end; all shingles of all texts are
counted for it. Every candidate of either kind is verified on the whole sets. Texts that share a shingle are not paired with each
other: one leader, then two, four and so on meet the rest of a shingle's holders, first of all those outside its largest group,
until no shingle has two groups with a member that has not led; pairs that share fewer first shingles than their sizes and
the similarity demand are not looked at. No link is lost, and a group of copies costs little, however large.

Nulls, empties, ties: a null text counts as empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle make one shingle of all. Every input row gives one
output row, repeated rows and ids too; null ids stay null and never name a component unless
all its ids are null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._common import BROADCAST_IDS, dropped, without, written

SHINGLE = 3
SEED = 42
#: Words of a shingle and least similarity for near_groups() and keep_one().
WORDS = 5
SIMILARITY = 0.8
#: Holders of a shingle that meet all its others in the first round; each round has twice as many as the one before.
LEADERS = 1
#: A shingle that more texts share goes to the end of the order; beyond MOST_COMMON times as many rows only the more common ones, so
#: that there are at most so many (8 bytes each, broadcast). The order changes no result.
COMMON = 8
MOST_COMMON = 1_000_000
#: Texts whose shingles a worker knows it has sent; it starts anew when they are so many.
SENT = 200_000
#: Shingles that a worker packs at once to be counted; a few arrays of so many stay in its memory.
COUNTED = 250_000
RADIUS = 3
#: Words whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 15
BLOCKS = ((0, 21), (21, 42), (42, 64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 values of all shingles of a text's words, repeats included, some at a time; fewer words than a shingle make one."""
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, max(1, len(words) - shingle + 1) if words else 0, CHUNK):
        part = words[start : start + CHUNK + shingle - 1]
        texts = [join(part)] if len(part) < shingle else map(join, zip(*[part[i:] for i in range(shingle)], strict=False))
        yield np.array([hash_of(x, SEED) for x in texts], dtype="<u8")


def simhash(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingle hashes as an unsigned 64-bit integer; of none, zero."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    return simhash(grams(words_of(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each emitted key: the bits to keep and the bits to flip (or the block's number, in its blank bits)."""
    keep, flip = [], []
    for k, (low, high) in enumerate(BLOCKS):
        blank = ((1 << high) - 1) ^ ((1 << low) - 1)
        tag = (k + 1) << low
        for change in [0, *(1 << i for i in range(64) if not blank >> i & 1)]:
            keep.append(blank ^ (2**64 - 1))
            flip.append(change | tag)
    return np.array(keep, dtype=np.uint64), np.array(flip, dtype=np.uint64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep, flip = _masks()
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(values), 2048):
            part = values[start : start + 2048]
            keys = ((part[:, None] & keep) ^ flip).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(keep)).view(np.int64))], names=["key", "fp"]
            )


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct uint64 values."""
    edges: list[tuple[int, int]] = []
    rest = values
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hit = rest[near]
                edges += [(int(x), int(y)) for y in hit]
                reached += list(hit)
                rest = rest[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified edges of rows (key, fp) sorted by key; the last key of a batch waits for the next one."""

    def of(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        a, b = values[two], values[two + 1]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        left, right = [a[near]], [b[near]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if edges := forest(np.unique(values[start : start + size])):
                found = np.array(edges, dtype=np.uint64)
                left.append(found[:, 0])
                right.append(found[:, 1])
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys) < 100_000 or keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield of(keys[:cut], values[:cut])
        keys, values = keys[cut:], values[cut:]
    if len(keys):
        yield of(keys, values)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, of a spanning forest of each key's links; distinct has one row per fp.

    Their transitive closure is that of all pairs at RADIUS or fewer differing bits.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(_variants, "key bigint, fp bigint")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Large-star and small-star in turn until nothing changes; O(log^2) rounds, each a written table.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = written(large, name)
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").filter("a < b").distinct(), name)
        dropped(large)
        dropped(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) for each row of docs(doc_id, text)."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    rooted = components(link_fingerprints(distinct), "fingerprint-links")
    joined = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = written(joined.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(nodes, "fp").select("doc_id", "fp", "component_id")


def _sketch(text: str | None, shingle: int) -> tuple[str, int, np.ndarray]:
    """The 128-bit name of a text's words, their fingerprint (as a signed long) and their distinct shingle hashes, ascending."""
    words = words_of(text)
    hashes = list(grams(words, shingle))
    fp = simhash(hashes)
    found = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, "<u8")
    return xxhash.xxh3_128_hexdigest(b" ".join(words)), fp - (fp >> 63 << 64), found


def _first(hashes: np.ndarray, similarity: float, late: tuple[np.ndarray, int]) -> np.ndarray:
    """The shingles of which one is common to any two sets at the similarity, in the order of (is in late, hash); late: see _common()."""
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    heads, shift = late
    if len(heads):
        own = hashes >> np.uint64(shift)
        hot = heads[np.minimum(np.searchsorted(heads, own), len(heads) - 1)] == own
        hashes = np.concatenate([hashes[~hot], hashes[hot]])
    return hashes[:n]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (128-bit name of the text's words), fp, m (distinct shingles) and new (the worker has not met the node before) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1):
                node, fp, found = _sketch(text.as_py(), shingle)
                for column, value in zip(out, (node, fp, len(found), node not in sent), strict=True):
                    column.append(value)
                sent.add(node)
            if len(sent) > SENT:
                sent = set()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "node", "fp", "m", "new"])

    return written(_rows(docs).mapInArrow(run, "doc_id bigint, node string, fp bigint, m int, new boolean"), "near-sketches")


def _short(node: str) -> int:
    """64 of a node's bits, which travel in its place where every find is looked up and verified later."""
    return int(node[:16], 16) - (int(node[0], 16) >> 3 << 64)


def _packed(heads: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Heads of shingles by part (all but their last 32 bits): the gaps of each part's sorted rest, byte by byte, so that the upper bytes are mostly zeros."""
    heads = np.sort(heads)
    ends = np.flatnonzero(np.diff(heads >> np.uint64(32), append=np.uint64(1 << 63))) + 1
    for start, end in zip([0, *ends[:-1]], ends, strict=False):  # of nothing there is no end
        part, rest = heads[start] >> np.uint64(32), heads[start:end].astype(np.uint32)
        gaps = np.diff(rest, prepend=np.uint32(0)).astype("<u4")
        yield int(part), gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, int]:
    """The heads of shingles that more than COMMON texts have, ascending, at most MOST_COMMON of them: beyond that the more common ones; and the bits that a head lacks.

    A head is a shingle's first 40 bits, or more where partitions are many: any order will do that is the same for all texts, so shingles
    that share a head may be counted together. A text counts once for each worker that meets it.
    """
    bits = max(8, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift = 32 - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()

        def batch_of(keys: list[np.ndarray]) -> pa.RecordBatch:
            rows = list(_packed(np.concatenate(keys) >> np.uint64(shift)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["part", "rest"])

        for batch in batches:
            keys, size = [np.zeros(0, np.uint64)], 0
            for text in batch.column(1):
                node, _, found = _sketch(text.as_py(), shingle)
                if node not in sent:
                    keys.append(found)
                    size += len(found)
                sent.add(node)
                if size > COUNTED:
                    yield batch_of(keys)
                    keys, size = [np.zeros(0, np.uint64)], 0
            if len(sent) > SENT:
                sent = set()
            yield batch_of(keys)

    def counts(group: pa.Table) -> pa.Table:
        heads, n = np.unique(np.concatenate([_unpacked(x.as_py()) for x in group.column("rest")]), return_counts=True)
        heads = (heads.astype(np.uint64) | np.uint64(group.column("part")[0].as_py()) << np.uint64(32))[n > COMMON]
        return pa.table({"key": pa.array(heads.view(np.int64)), "n": pa.array(n[n > COMMON])})

    packed = _rows(docs).mapInArrow(run, "part int, rest binary")
    counted = written(packed.groupBy("part").applyInArrow(counts, "key bigint, n bigint"), "near-common")
    limit = max(COMMON, -(-(counted.agg(F.sum("n")).first()[0] or 0) // MOST_COMMON))
    found = counted.filter(F.col("n") > limit).select("key").toPandas()["key"].to_numpy(np.int64)
    dropped(counted)
    return np.sort(found.view(np.uint64)), shift


def _ordered_keys(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, int]) -> DataFrame:
    """key and a (short node) for the first shingles of all texts, with the shingles `common` at the end of the order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, sent = shared.value, set()
        for batch in batches:
            keys, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(1):
                node, _, found = _sketch(text.as_py(), shingle)
                if node not in sent:
                    keys.append(_first(found, similarity, late).view(np.int64))
                    names.append(np.full(len(keys[-1]), _short(node), np.int64))
                sent.add(node)
            if len(sent) > SENT:
                sent = set()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], names=["key", "a"])

    return _rows(docs).mapInArrow(run, "key bigint, a bigint")


def _shared(keyed: DataFrame) -> DataFrame:
    """The distinct rows (key, a) whose key two texts have."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; only the last one waits for the next batch, so a common key takes no memory.
        wait, before = np.zeros((0, 2), np.int64), False
        for batch in batches:
            rows = np.concatenate([wait, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            left = np.concatenate(([before], same))
            out = rows[:-1][left[:-1] | same]
            wait, before = rows[-1:], bool(left[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(2)], names=["key", "a"])
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(wait[:, i])) for i in range(2)], names=["key", "a"])

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(keyed.repartition(n, "key").sortWithinPartitions("key", "a").mapInArrow(linked, "key bigint, a bigint"), "near-keys")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets (id, s) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id and s (all distinct shingle hashes, as bytes) of the ids; a written table. Only rows of their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                found = [_sketch(t.as_py(), shingle) for t in batch.column(1)[start : start + 500]]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in found], pa.string()), pa.array([h.tobytes() for *_, h in found], pa.binary())], names=["node", "s"])

    wanted = written(ids.select("id").distinct().join(nodes, "id").select("id", "node"), "near-wanted")
    rows = written(sketches.filter("new").join(wanted, "node").select(F.col("doc_id").alias("of")).distinct(), "near-wanted-rows")
    few = rows.count() <= BROADCAST_IDS
    texts = _rows(docs)
    texts = texts.join(F.broadcast(rows) if few else rows.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    made = texts.mapInArrow(run, "node string, s binary").join(wanted, "node")
    return written(made.select("id", "s").dropDuplicates(["id"]), "near-sets")


def _least_shared(m: Column, n: Column, similarity: float) -> Column:
    """How many of their first shingles two sets of m and n at the similarity share at least.

    Of the set whose first shingles end earlier in the order, all that the other one has count as shared, and at most m less the least
    common number are not among the other's. Which of the two it is is not known, so the lesser bound holds.
    """
    common = F.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)
    spare = lambda k: (k - F.ceil(similarity * k - 1e-9) + 1) - (k - common)
    return F.greatest(F.lit(1), F.least(spare(m), spare(n)))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_groups(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable over pairs of texts at the similarity or more) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    sketches = _sketches(docs, shingle)
    nodes = sketches.groupBy("node", "fp", "m").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes.withColumn("a", F.conv(F.substring("node", 1, 16), 16, -10).cast("bigint")), "near-nodes")
    # Balls of fingerprints.
    points = written(nodes.groupBy("fp").agg(F.min("id").alias("point")), "near-points")
    met = link_fingerprints(points).join(points.select(F.col("fp").alias("a"), F.col("point").alias("p")), "a").join(points.select(F.col("fp").alias("b"), F.col("point").alias("q")), "b")
    close = met.select(*_pair("p", "q")).union(nodes.join(points, "fp").filter("id <> point").select(*_pair("id", "point")))
    close = written(close.distinct(), "near-close")
    sets = _sets(docs, sketches, nodes, close.select(F.explode(F.array("a", "b")).alias("id")), shingle)
    roots = written(components(_verified(close, sets, similarity), "near-stars"), "near-roots")
    dropped(sets)
    # What differs by more: texts that share one of their first shingles.
    keys = _shared(_ordered_keys(docs, shingle, similarity, _common(docs, shingle)))
    rows = _open(keys.join(nodes.select("id", "m", "a"), "a").select("key", "id", "m", F.col("id").alias("root"), F.lit(False).alias("led")), roots)
    by_hash = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    turns = LEADERS
    while True:
        outside = rows.filter("root <> most and not led").withColumn("turn", F.row_number().over(by_hash))
        leaders = written(outside.filter(F.col("turn") <= turns).select("id").distinct(), "near-leaders")
        if leaders.isEmpty():
            break
        own = rows.join(leaders, "id").select("key", F.col("id").alias("p"), F.col("m").alias("of"), F.col("root").alias("from"))
        other = rows.filter("not led").select("key", F.col("id").alias("q"), "m", "root")
        fits = (F.col("root") != F.col("from")) & (F.least("m", "of") >= similarity * F.greatest("m", "of") - 1e-9)
        met = own.join(other.hint("merge"), "key").filter(fits).groupBy("p", "q", "m", "of").agg(F.count("*").alias("shared"))
        pairs = written(met.filter(F.col("shared") >= _least_shared(F.col("m"), F.col("of"), similarity)).select(*_pair("p", "q")).distinct(), "near-pairs")
        sets = _sets(docs, sketches, nodes, pairs.select(F.explode(F.array("a", "b")).alias("id")), shingle)
        now = written(_joined(roots, _verified(pairs, sets, similarity)), "near-roots")
        left = rows.join(leaders.withColumn("now", F.lit(True)), "id", "left").select("key", "id", "m", "root", (F.col("led") | F.col("now").isNotNull()).alias("led"))
        left = _open(left, now)
        for old in (pairs, sets, leaders, rows, roots):
            dropped(old)
        rows, roots, turns = left, now, 2 * turns
    named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).select("node", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("node", "component_id"), "near-components")
    return sketches.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after the links (a, b) of nodes; only the links of unlike roots are worked on, as links of roots."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    rooted = rooted.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = written(components(rooted, "near-stars").withColumnRenamed("root", "onto"), "near-merged")
    kept = roots.join(merged.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    return kept.union(merged.join(roots, "node", "left_anti").select("node", F.col("onto").alias("root")))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (key, id, m, root, led) with their roots brought up to date and most, the root that has most of a key's rows; of keys with one root, none.

    Roots only ever merge, so a key that has one is done with. A written table.
    """
    now = rows.drop("root").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    now = written(now, "near-rows")
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("n", "root"))["root"].alias("most"))
    kept = written(now.join(sizes.filter("groups > 1").select("key", "most"), "key"), "near-open")
    dropped(now)
    return kept


def keep_one(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near_groups() component; rows with a null id stay."""
    return without(docs, near_groups(docs, shingle, similarity).filter("doc_id <> component_id").select("doc_id").distinct())
