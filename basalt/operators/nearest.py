"""The kernel of vector searches: blocks of vectors meet blocks of queries by matrix products, and the distances of what may be among the best are worked out one by one.

Distances are summed in doubles in the order of the elements, as the column expressions of vector.py do, so both give the same bits. A matrix product
only decides which rows are looked at; its rounding is allowed for, so no row is lost. Rows whose length is not a query's are as far
as vector.distance() says; a null or NaN element makes the distance NaN, which comes last. Ties go by id, null ids first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers in a block of vectors, and in its distances to a block of queries (32 MB each).
BLOCK = 4_000_000
#: Candidates whose distances are worked out at once, so that they stay in a core's cache.
AT_ONCE = 1_000


@dataclass
class Queries:
    """Queries of one length: ids, a row of q for each, and the lists that each probes (all, if None)."""

    ids: pa.Array
    q: np.ndarray
    probed: np.ndarray | None = None


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of d doubles (zeros, if of another length), and which are of that length."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = (lengths == d) & (d > 0)
    rows = np.zeros((len(column), d))
    if fits.any():
        flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        rows[fits] = flat[np.repeat(fits, np.maximum(lengths, 0))].reshape(-1, d)
    return rows, fits


def by_length(table: pa.Table) -> list[Queries]:
    """A table of queries(qid, q), a part for each length."""
    ids, q = (table.column(c).combine_chunks() for c in ("qid", "q"))
    lengths = q.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = [(int(d), pa.array(np.flatnonzero(lengths == d))) for d in np.unique(lengths)]
    return [Queries(ids.take(at), matrix(q.take(at), d)[0]) for d, at in parts]


def exact(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The distances of paired rows."""

    def total(a: np.ndarray, b: np.ndarray, pair: Callable) -> np.ndarray:
        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            s += pair(a[:, j], b[:, j])
        return s

    times = lambda x, y: x * y
    if metric == "euclidean":
        return np.sqrt(total(v, q, lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return total(v, q, lambda x, y: np.abs(x - y))
    if metric == "dot":
        return -total(v, q, times)
    scale = np.sqrt(total(v, v, times)) * np.sqrt(total(q, q, times))
    return 1 - np.where(scale == 0, 0.0, total(v, q, times) / np.where(scale == 0, 1.0, scale))


FAR = {"euclidean": np.inf, "manhattan": np.inf, "cosine": 1.0, "dot": -0.0}


def rough(v: np.ndarray, fits: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For each query a number for each row that grows with the distance, and how far rounding may move it."""
    with np.errstate(all="ignore"):
        rounding = 8 * (v.shape[1] + 8) * np.finfo(float).eps
        vv, qq = (v * v).sum(axis=1), (q * q).sum(axis=1, keepdims=True)
        most = np.max(vv, where=np.isfinite(vv), initial=0.0)
        if metric == "manhattan":
            out, slack = np.zeros((len(q), len(v))), np.zeros_like(qq)
            for j in range(v.shape[1]):
                out += np.abs(v[:, j] - q[:, j : j + 1])
        elif metric == "euclidean":
            out, slack = q @ v.T, rounding * (qq + most)
            out *= -2
            out += vv
        elif metric == "dot":
            out, slack = -(q @ v.T), rounding * np.sqrt(qq * most)
        else:
            unit = lambda x, xx: x / np.sqrt(np.where(xx == 0, 1.0, xx))
            out, slack = -(unit(q, qq) @ unit(v, vv[:, None]).T), np.full_like(qq, rounding)
    if not fits.all():
        out[:, ~fits] = np.inf if metric in ("euclidean", "manhattan") else 0.0
    return out, slack


def nearest(queries: Queries, v: np.ndarray, fits: np.ndarray, k: int, metric: str, lists: np.ndarray | None = None, decoded: np.ndarray | None = None, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest rows of each query as (query, row, distance), ties by row; of lists, only those that it probes.

    With decoded, what the rows' codes stand for, only the `keep` rows that are nearest by it (and ties) are ranked.
    """
    step, width = max(1, BLOCK // max(1, len(v))), keep or k
    for a in range(0, len(queries.q), step):
        q = queries.q[a : a + step]
        if lists is None:
            near, slack = rough(v, fits, q, metric)
            asked = None
        else:
            probed = queries.probed[a : a + step]
            near, slack, asked = np.full((len(q), len(v)), np.inf), np.zeros((len(q), 1)), probed[:, lists]
            for one in np.unique(lists):
                who, rows = np.flatnonzero(probed[:, one]), np.flatnonzero(lists == one)
                if len(who):
                    near[np.ix_(who, rows)], s = rough((v if decoded is None else decoded)[rows], fits[rows], q[who], metric)
                    slack[who] = np.maximum(slack[who], s)
        if width < len(v):
            may = ~(near > np.partition(near, width - 1, axis=1)[:, width - 1 : width] + (2 * slack if decoded is None else 0))
        else:
            may = np.ones(near.shape, bool)
        qi, ri = np.nonzero(may if asked is None else may & asked)
        distance = np.empty(len(qi))
        with np.errstate(all="ignore"):
            for i in range(0, len(qi), AT_ONCE):
                at = slice(i, i + AT_ONCE)
                distance[at] = np.where(fits[ri[at]], exact(v[ri[at]], q[qi[at]], metric), FAR[metric])
        order = np.lexsort((ri, distance, qi))
        qi, ri, distance = qi[order], ri[order], distance[order]
        first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        yield qi[first] + a, ri[first], distance[first]


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches with a list column v, put together to blocks of about BLOCK numbers, each in order of id."""

    def block() -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.take(pc.array_sort_indices(table.column("id").combine_chunks(), null_placement="at_start"))

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("v").flatten()) + batch.num_rows
        if size >= BLOCK:
            yield block()
            held, size = [], 0
    if held:
        yield block()
