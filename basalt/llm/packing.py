"""Harmonic packing of token sequences.

A piece of length in (C / (k + 1), C / k] belongs to class k, and a bin of class k takes
exactly k pieces, so a worker fills bins with one open bin per class and nothing to search for. Documents
may be cut: full capacities come first, then a remainder that would leave over `waste` of a bin
of its class unused gives a piece of exactly C / (k + 1) to the next class and goes on with the rest.

Workers are independent: there is no shuffle, each partition numbers its own
sequences within its own range, and what its open bins hold at the end is packed together by
first-fit decreasing, so a worker leaves about one sequence that is not nearly full. A retried
task reads the same rows and makes the same sequences.

Nulls, empties, ties: a null text counts as empty; an empty text is the end id alone, one piece. Every row
is packed, repeated rows and null ids too. Extra columns are ignored. An empty table gives no rows.
Texts are encoded whole, as tokenizers encodes them with add_special_tokens=False: a special token's string within a text gives its id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END = 1
WASTE = 0.02
#: A remainder is cut into at most this many pieces, none of them shorter than SHORT by choice.
PIECES = 4
SHORT = 24
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Piece lengths of a document of some tokens, in order."""
    pieces = [capacity] * (length // capacity)
    rest, allowed = length % capacity, PIECES
    while rest:
        k = capacity // rest
        first = capacity // (k + 1)
        if allowed == 1 or rest < 2 * SHORT or k * rest >= (1 - waste) * capacity or rest - first < SHORT:
            pieces.append(rest)
            break
        pieces.append(first)
        rest -= first
        allowed -= 1
    return pieces


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids by the vocabulary file of the tokenizers library at path.

    A byte-level BPE file whose ids follow its merges is run by tiktoken, which gives the same ids in a
    fraction of the time; any other file, and any text that it refuses, by tokenizers itself.
    """
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    whole = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    in_order = model.get("type") == "BPE" and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    strict = [t for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    overlap = any(a != b and a in b for a in added for b in added)
    if not (plain and in_order and not model.get("ignore_merges") and not model.get("dropout")) or strict or overlap:
        return slow
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in added}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return slow(text)

    return encode


class Bins:
    """One worker's open bins: a list of pieces for each class."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def put(self, piece: tuple) -> list | None:
        """The bin that the piece completes, if it does."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else None

    def rest(self) -> Iterator[list]:
        """What open bins hold, first-fit decreasing; at most one bin per class is open."""
        bins: list[tuple[int, list]] = []
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            at = next((i for i, (room, _) in enumerate(bins) if room >= piece[2]), None)
            if at is None:
                bins.append((self.capacity - piece[2], [piece]))
            else:
                bins[at] = (bins[at][0] - piece[2], [*bins[at][1], piece])
        for _, held in bins:
            yield held


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, waste: float = WASTE) -> DataFrame:
    """Pieces of all docs(doc_id, text): doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer_path), Bins(capacity)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(held: list) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, length, ids, total in held:
                rows.append((doc_id, start, length, ids, total, number, offset))
                offset += length
            number += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.binary() if c.endswith("binary") else pa.int64() for c in SCHEMA.split(", ")]
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity, waste):
                    full = bins.put((doc_id.as_py(), start, length, ids[start : start + length].tobytes(), len(ids)))
                    start += length
                    if full:
                        emit(full)
                if len(rows) >= 4000:
                    yield flush()
        for held in bins.rest():
            emit(held)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
