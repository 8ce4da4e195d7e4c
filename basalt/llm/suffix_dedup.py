"""Suffix-array dedup: bytes within repeated strings of LENGTH bytes go, by a common-prefix-aware distributed merge sort.

Sorting a suffix at every byte would carry LENGTH times the corpus. Every string of LENGTH bytes is
represented by its anchor instead, the place in it whose 48-byte gram has the least hash (the
leftmost of equals): equal strings have their anchors at the same offset, and an anchor speaks for a run
of neighbouring starts, about 75 of them. So the suffix array is sparse and the result still exact:

1. Anchors (gram hash, text, place, range of offsets) of all texts, from each batch's bytes at once; those whose
   gram occurs once are dropped after one shuffle of 24-byte rows, streamed in order of the hash. Rows that find a partner in
   their own batch are spread evenly, so a very common gram does not gather in one task.
2. Each worker sorts the suffixes at its remaining anchors, equal ones as one, and front-codes the run: the
   length shared with the suffix before, and the rest. Runs are exchanged by gram hash.
3. Each part's runs are merged by a loser tree whose players keep the prefix length they share with the last
   winner, so no known prefix is compared again. The merged order's common-prefix lengths, with those of the
   bytes before the anchors sorted likewise, tell for every offset which strings are equal, exactly.
4. Repeated starts become byte ranges, which meet the texts again and are cut out.

A gram with more than HOT anchors (a footer under a third of all pages) would fill its part: so the strings of such
grams, one for each offset, are told by 128-bit hashes. Workers settle what is equal among their own, and one of each goes with the
runs to the part of its hash, where equal neighbours are found. So no part depends on how common a gram or a string is.

Texts are told apart by 128 bits (see text_name); copies of a text are read once in steps 2 and 3, and all their bytes are
repeated anyway. The number of parts follows the number of anchors, so a part's size does not grow
with the input. Nothing is collected.

Nulls, empties, ties: a null text counts as empty; texts under LENGTH bytes keep everything. Occurrences may overlap
(a run of one letter longer than LENGTH goes). Every row gives one row and counts as a document of its
own, repeated rows and null ids too. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._common import text_name, written

LENGTH = 200
GRAM = 48
#: Starts that one anchor can speak for.
REACH = LENGTH - GRAM + 1
#: Bytes that are hashed at once; a place within them takes PLACE bits.
PIECE = 1 << 20
PLACE = 21
#: Anchors in one part of the exchange, on average.
PART = 40_000
#: Anchors of one gram that are merged; beyond, its strings are hashed. At most MOST_HOT grams are (8 bytes each, broadcast).
HOT = 10_000
MOST_HOT = 1_000_000
#: What a hot anchor's strings weigh in a part, in anchors.
HOT_WEIGHT = 8
#: Bytes of suffixes that a worker gathers before it closes its runs.
RUN_BYTES = 48 << 20
MULT = 0x9E3779B97F4A7C15
U = np.uint64


def _hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all grams of GRAM = 48 bytes."""
    grams, power, size, halves = data.astype(U) + U(1), MULT, 1, {}
    while size < 32:
        grams = grams[:-size] * U(power) + grams[size:]
        power, size = power * power % 2**64, size * 2
        halves[size] = (grams, power)
    (short, power16), (long, _) = halves[16], halves[32]
    h = long[: len(data) - GRAM + 1] * U(power16) + short[32 : len(data) - GRAM + 33]
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    return h


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, place in data, least offset, greatest offset, gram hash) of texts [start, end) within data, each of LENGTH bytes or more."""
    h = _hashes(data)
    low = U((1 << PLACE) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=U)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    change = np.zeros(len(least) + 1, dtype=np.int32)
    change[starts] += 1
    change[ends - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(change[:-1]))
    place = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    place = place[first]
    return np.searchsorted(starts, at[first], "right") - 1, place, place - at[last], place - at[first], h[place]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, tid, packed (place << 16 | least offset << 8 | greatest offset) and sure of texts (tid, text) of LENGTH bytes or more."""
    for batch in batches:
        tids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = _texts(batch.column(1))
        # Long texts are cut into pieces that share LENGTH - 1 bytes; pieces are taken together up to PIECE bytes.
        pieces = [(i, s, min(s + PIECE, int(offsets[i + 1]))) for i in range(len(tids)) for s in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[i + 1]) - LENGTH + 1), PIECE - LENGTH + 1)]
        while pieces:
            base, n = pieces[0][1], 1
            while n < len(pieces) and pieces[n][0] != pieces[n - 1][0] and pieces[n][2] - base <= PIECE:
                n += 1
            group, pieces = np.array(pieces[:n], dtype=np.int64), pieces[n:]
            piece, place, lo, hi, h = _anchors(data[base : group[-1, 2]], group[:, 1] - base, group[:, 2] - base)
            text = group[piece, 0]
            packed = (place + base - offsets[text]) << 16 | lo << 8 | hi
            yield _settled(np.stack([h.view(np.int64), tids[text], packed], axis=1))


def _settled(rows: np.ndarray) -> pa.RecordBatch:
    """Rows (h, tid, packed), sure where another row here has the same h, and one of these once more as not sure.

    Sure rows need not meet the others, so they can go anywhere: of a very common gram only
    one row from each batch goes to the place of the gram.
    """
    rows = np.unique(rows, axis=0)
    same = rows[1:, 0] == rows[:-1, 0]
    sure = np.append(same, False) | np.insert(same, 0, False)
    first = sure & ~np.insert(same, 0, False)
    rows, sure = np.concatenate([rows, rows[first]]), np.concatenate([sure, np.zeros(first.sum(), bool)])
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)), pa.array(sure)], names=["h", "tid", "packed", "sure"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, tid and packed of rows that are sure or whose h another row has too.

    The others come sorted by h, tid and packed, and equal ones count once. Only the last row waits for
    the next batch, so a common gram takes no memory.
    """
    wait, linked = np.zeros((0, 3), np.int64), False
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        sure = batch.column(3).to_numpy(zero_copy_only=False)
        if sure.any():
            yield _columns(rows[sure])
        rows = np.concatenate([wait, rows[~sure]])
        rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))] if len(rows) else rows
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        before, after = np.concatenate(([linked], same)), np.append(same, False)
        out = rows[:-1][(before | after)[:-1]]
        wait, linked = rows[-1:], bool(before[-1])
        yield _columns(out)
    if linked:
        yield _columns(wait)


def _columns(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["h", "tid", "packed"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which share `known` bytes for certain."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and the rest."""
    shared, tails, last = [], [], b""
    for s in suffixes:
        n = common(last, s)
        shared.append(n)
        tails.append(s[n:])
        last = s
    return shared, tails


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order (run, index) of sorted runs (suffixes, shared lengths), and the length each shares with the one before in it.

    A loser tree: a player at a node knows the prefix it shares with the winner that passed there. Of two players that
    share different lengths with the last winner the one that shares more is smaller, without a look at their
    bytes; only equal lengths are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * len(runs)
    gone = (None, -1, -1)  # suffix, shared with the last winner, run
    players = [(r[0][0], 0, i) if r[0] else gone for i, r in enumerate(runs)] + [gone] * (size - len(runs))

    def play(a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """(winner, loser); the loser's length becomes that shared with the winner."""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[0] is None or b[0] is None:
            return (a, b) if b[0] is None else (b, a)
        n = common(a[0], b[0], a[1])
        first = len(a[0]) == n or (len(b[0]) > n and a[0][n] < b[0][n])
        return (a, (b[0], n, b[2])) if first else (b, (a[0], n, a[2]))

    losers: list[tuple] = [gone] * size
    level, nodes = players, size
    while nodes > 1:
        level = [play(level[i], level[i + 1]) for i in range(0, nodes, 2)]
        nodes //= 2
        for i, (_, loser) in enumerate(level):
            losers[nodes + i] = loser
        level = [w for w, _ in level]
    winner = level[0]
    order, shared = [], []
    while winner[0] is not None:
        run = winner[2]
        order.append((run, at[run]))
        shared.append(winner[1])
        at[run] += 1
        suffixes, known = runs[run]
        player = (suffixes[at[run]], known[at[run]], run) if at[run] < len(suffixes) else gone
        node = (size + run) // 2
        while node:
            player, losers[node] = play(player, losers[node])
            node //= 2
        winner = player
    return order, shared


RUN_COLUMNS = ("shared", "sizes", "tails", "left_sizes", "lefts", "lo", "hi", "counts", "refs")
#: Besides a run a row may carry ranges that are `done`, and hashed strings (two halves of the hash, tid, start).
RUN_SCHEMA = "part int, " + ", ".join(f"{c} binary" for c in (*RUN_COLUMNS, "done", "strings"))


def _row(part: int, run: tuple = (None,) * len(RUN_COLUMNS), done: np.ndarray | None = None, strings: np.ndarray | None = None) -> pa.RecordBatch:
    cells = (*run, None if done is None else done.tobytes(), None if strings is None else strings.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["part", *RUN_COLUMNS, "done", "strings"])


def hashed_strings(data: bytes, tid: int, places: set[int]) -> np.ndarray:
    """Rows (two halves of the hash, tid, start) of the strings of LENGTH bytes that the anchors `places` of a text speak for."""
    starts = [s for packed in places for s in range((packed >> 16) - (packed & 255), (packed >> 16) - (packed >> 8 & 255) + 1)]
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + LENGTH]) for s in starts), np.int64).reshape(-1, 2)
    return np.concatenate([hashes, np.full((len(starts), 1), tid, np.int64), np.array(starts, np.int64).reshape(-1, 1)], axis=1)


def equal_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of hashed_strings(): the ranges (tid, start, end) of those that are not alone, and one row of each string."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    first = np.insert(~same, 0, True) if len(rows) else np.zeros(0, bool)
    alone = first & np.append(~same, True) if len(rows) else first
    many = rows[~alone][:, 2:]
    many = many[np.lexsort((many[:, 1], many[:, 0]))]
    if not len(many):
        return np.zeros((0, 3), np.int64), rows[first]
    # Neighbouring starts of a text make one range.
    begins = np.insert((many[1:, 0] != many[:-1, 0]) | (many[1:, 1] > many[:-1, 1] + 1), 0, True)
    ends = np.append(begins[1:], True)
    return np.stack([many[begins, 0], many[begins, 1], many[ends, 1] + LENGTH], axis=1), rows[first]


def _make_runs(parts: int):
    """Sorted, front-coded runs of the suffixes at anchors `packed` of texts (tid, text, packed, hot), one row for each part.

    Strings of the anchors `hot` go as hashes. Anchors that are alike on both sides are repeated strings for certain: their ranges go out as `done`, to a part picked by
    the task, and one of them stands for all in the run.
    """

    def close(held: dict, strings: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ranges = [(tid, p - hi, p - lo + LENGTH) for entries in held.values() for (_, _, lo, hi), refs in entries.items() if len(refs) > 1 for tid, p in refs]
        settled, rest = equal_strings(np.concatenate([np.zeros((0, 4), np.int64), *strings]))
        done = np.concatenate([np.array(ranges, np.int64).reshape(-1, 3), settled])
        spread = TaskContext.get().partitionId() * 7919
        for i in range(0, len(done), PART):
            yield _row((spread + i) % parts, done=done[i : i + PART])
        for part, entries in held.items():
            rows = sorted((k, v[:1]) for k, v in entries.items())
            shared, tails = front_code([k[0] for k, _ in rows])
            refs = [np.array(v, np.int64) for _, v in rows]
            yield _row(part, (
                bytes(shared), bytes(map(len, tails)), b"".join(tails), bytes(len(k[1]) for k, _ in rows), b"".join(k[1] for k, _ in rows),
                bytes(k[2] for k, _ in rows), bytes(k[3] for k, _ in rows), np.array([len(v) for v in refs], np.int32).tobytes(), np.concatenate(refs).tobytes(),
            ))
        of = rest[:, 0].view(U) % U(parts)
        order = np.argsort(of, kind="stable")
        rest, of = rest[order], of[order]
        begins = np.flatnonzero(np.insert(of[1:] != of[:-1], 0, True)) if len(of) else []
        for begin, end in zip(begins, [*begins[1:], len(of)], strict=False):
            yield _row(int(of[begin]), strings=rest[begin:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple, list]] = {}
        strings: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for tid, text, places, hot in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for packed in set(places.as_py()):
                    p, lo, hi = packed >> 16, packed >> 8 & 255, packed & 255
                    part = xxhash.xxh64_intdigest(data[p : p + GRAM], 7) % parts
                    key = (data[p : p - lo + LENGTH], data[p - hi : p][::-1], lo, hi)
                    held.setdefault(part, {}).setdefault(key, []).append((tid, p))
                    size += LENGTH + 200
                if hot.as_py():
                    strings.append(hashed_strings(data, tid, set(hot.as_py())))
                    size += strings[-1].nbytes
                if size > RUN_BYTES:
                    yield from close(held, strings)
                    held, strings, size = {}, [], 0
        yield from close(held, strings)

    return run


def _split(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _repeated(table: pa.Table) -> pa.Table:
    """tid, start and end of byte ranges that repeated strings cover, from the runs of one part and the strings hashed to it."""
    runs, more = [], []
    out = [np.frombuffer(d, np.int64).reshape(-1, 3) for d in table.column("done").to_pylist() if d]
    strings = [np.frombuffer(d, np.int64).reshape(-1, 4) for d in table.column("strings").to_pylist() if d]
    if strings:
        out.append(equal_strings(np.concatenate(strings))[0])
    for row in table.select(RUN_COLUMNS).to_pylist():
        if row["shared"] is None:
            continue
        suffixes, last = [], b""
        for n, tail in zip(row["shared"], _split(row["sizes"], row["tails"]), strict=True):
            last = last[:n] + tail
            suffixes.append(last)
        counts = np.frombuffer(row["counts"], np.int32)
        refs = np.split(np.frombuffer(row["refs"], np.int64).reshape(-1, 2), np.cumsum(counts)[:-1])
        runs.append((suffixes, list(row["shared"])))
        more.append((_split(row["left_sizes"], row["lefts"]), row["lo"], row["hi"], refs))
    if not runs:
        rows = np.concatenate(out)
        return pa.table({"tid": rows[:, 0], "start": rows[:, 1], "end": rows[:, 2]})
    order, shared = merge(runs)
    n = len(order)
    lefts = [more[r][0][i] for r, i in order]
    lo = np.array([more[r][1][i] for r, i in order], np.int64)
    hi = np.array([more[r][2][i] for r, i in order], np.int64)
    refs = [more[r][3][i] for r, i in order]
    weight = np.array([len(x) for x in refs], np.int64)
    right_shared = np.array(shared, np.int64)
    left_order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_shared = np.array([0, *(common(lefts[a], lefts[b]) for a, b in zip(left_order[:-1], left_order[1:], strict=True))], np.int64)
    found = np.zeros((n, REACH + 2), np.int8)
    left = np.zeros(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        # Strings that begin d bytes before their anchors are equal if both sides' classes are.
        at = np.flatnonzero((lo <= d) & (d <= hi))
        left[left_order] = np.cumsum(left_shared < d)
        key = np.cumsum(right_shared < LENGTH - d)[at] * (n + 1) + left[at]
        _, group = np.unique(key, return_inverse=True)
        found[at, d + 1] = np.bincount(group, weights=weight[at])[group] > 1
    step = np.diff(found, axis=1)
    entry, first = np.nonzero(step == 1)
    _, past = np.nonzero(step == -1)
    for e, d0, d1 in zip(entry.tolist(), first.tolist(), (past - 1).tolist(), strict=True):
        r = refs[e]
        out.append(np.stack([r[:, 0], r[:, 1] - d1, r[:, 1] - d0 + LENGTH], axis=1))
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pa.table({"tid": rows[:, 0], "start": rows[:, 1], "end": rows[:, 2]})


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ascending ranges that cover the same bytes; touching ranges are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def exchanged_runs(docs: DataFrame, tid: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of RUN_SCHEMA that go to parts, and the texts (tid, first, copies, size)."""
    spark = docs.sparkSession
    base = docs.filter(F.octet_length("text") >= LENGTH).select(F.col("doc_id").cast("bigint").alias("doc_id"), tid.alias("tid"), F.col("text").cast("string").alias("text"))
    texts = written(base.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max(F.octet_length("text")).cast("bigint").alias("size")), "texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = base.select("tid", "text").mapInArrow(_find_anchors, "h bigint, tid bigint, packed bigint, sure boolean")
    spread = F.when(F.col("sure"), F.xxhash64("tid", "packed")).otherwise(F.col("h"))
    shared = written(anchors.repartition(n, spread).sortWithinPartitions("sure", "h", "tid", "packed").mapInArrow(_shared, "h bigint, tid bigint, packed bigint"), "anchors")
    total = shared.count()
    most = max(HOT, -(-total // MOST_HOT))
    hot = written(shared.groupBy("h").agg(F.count("*").alias("anchors")).filter(F.col("anchors") > most), "hot-grams")
    heavy = hot.agg(F.sum("anchors")).first()[0] or 0
    parts = max(n, -(-(total + HOT_WEIGHT * heavy) // PART))
    marked = shared.join(F.broadcast(hot.select("h", F.lit(True).alias("hot"))), "h", "left")
    lists = marked.groupBy("tid").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("packed"))).alias("packed"), F.collect_list(F.when(F.col("hot"), F.col("packed"))).alias("hot")
    )
    lists = lists.join(texts.select("tid", "first"), "tid").withColumnRenamed("tid", "of")
    chosen = base.join(lists.hint("merge"), (F.col("tid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("tid", "text", "packed", "hot")
    return chosen.mapInArrow(_make_runs(parts), RUN_SCHEMA), texts


def repeated_ranges(docs: DataFrame, tid: Column) -> DataFrame:
    """tid (the texts' names) with arrays starts and ends of byte ranges that repeated strings of LENGTH bytes cover."""
    runs, texts = exchanged_runs(docs, tid)
    ranges = runs.groupBy("part").applyInArrow(_repeated, "tid bigint, start bigint, end bigint")
    whole = texts.filter("copies > 1").select("tid", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    every = written(ranges.unionByName(whole), "ranges")
    return every.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("r")).select("tid", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes, binary) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cuts = union(starts.values.to_numpy(), ends.values.to_numpy()) if starts.is_valid else []
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append(len(cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    tid = text_name(docs)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), tid.alias("tid"))
    # Written first, so that the join has an exchange on both sides and many copies of a text can be dealt to several tasks.
    found = written(repeated_ranges(docs, tid), "ranges-by-text")
    joined = base.join(found.hint("merge"), "tid", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
