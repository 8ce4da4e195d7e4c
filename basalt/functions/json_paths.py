"""JSON functions that change documents: one path walker with modes, as Arrow-batched functions.

Paths are $, .key, ."key", [n] and [last]. Invalid JSON or paths give NULL, as does a NULL document.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType

STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[\s]+))|\[(\d+|last)\]')


def steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(path)
    at, found = 1, []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(path)
        found.append(m[1] if m[1] is not None else m[2] if m[2] is not None else -1 if m[3] == "last" else int(m[3]))
        at = m.end()
    return found


def _value(text):
    """Arguments are SQL strings; those that are JSON scalars or containers other than strings keep their type."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def _holder(doc, path: list):
    """The container that holds the last step of a path, or None."""
    for step in path[:-1]:
        if isinstance(doc, dict) and isinstance(step, str) and step in doc:
            doc = doc[step]
        elif isinstance(doc, list) and isinstance(step, int) and -len(doc) <= step < len(doc):
            doc = doc[step]
        else:
            return None
    return doc


def _has(holder, step) -> bool:
    if isinstance(holder, dict):
        return isinstance(step, str) and step in holder
    return isinstance(holder, list) and isinstance(step, int) and -len(holder) <= step < len(holder)


def assign(doc, path: str, value, mode: str):
    """doc with a value set, inserted (if absent) or replaced (if present) at a path."""
    at = steps(path)
    if not at:
        return value if mode != "insert" else doc
    holder, last = _holder(doc, at), at[-1]
    there = _has(holder, last)
    if there and mode != "insert":
        holder[last] = value
    elif not there and mode != "replace":
        if isinstance(holder, dict) and isinstance(last, str):
            holder[last] = value
        elif isinstance(holder, list) and isinstance(last, int):
            holder.append(value)
    return doc


def remove(doc, path: str):
    at = steps(path)
    holder = _holder(doc, at) if at else None
    if holder is not None and _has(holder, at[-1]):
        del holder[at[-1]]
    return doc


def append(doc, path: str, value):
    """Adds to the array at a path; another value there becomes an array of the two."""
    at = steps(path)
    if not at:
        return [*doc, value] if isinstance(doc, list) else [doc, value]
    holder = _holder(doc, at)
    if holder is not None and _has(holder, at[-1]):
        old = holder[at[-1]]
        holder[at[-1]] = [*old, value] if isinstance(old, list) else [old, value]
    return doc


def array_insert(doc, path: str, value):
    at = steps(path)
    holder = _holder(doc, at)
    if at and isinstance(holder, list) and isinstance(at[-1], int):
        holder.insert(at[-1] if at[-1] >= 0 else len(holder) - 1, value)
    return doc


def merge_patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merge_preserve(a[k], v) if k in a else v for k, v in b.items()}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def depth(doc) -> int:
    inner = doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else ()
    return 1 + max(map(depth, inner), default=0)


def contains(target, candidate) -> bool:
    if isinstance(target, list):
        if isinstance(candidate, list):
            return all(contains(target, c) for c in candidate)
        return any(contains(t, candidate) for t in target)
    if isinstance(target, dict):
        return isinstance(candidate, dict) and all(k in target and contains(target[k], v) for k, v in candidate.items())
    return type(target) is type(candidate) and target == candidate


def _map(series: tuple[pd.Series, ...], change) -> pd.Series:
    def one(row):
        if any(x is None for x in row[:1]):
            return None
        try:
            return change(*row)
        except (ValueError, KeyError, IndexError, TypeError):
            return None

    return pd.Series([one(row) for row in zip(*series, strict=True)], dtype=object)


def _dump(doc) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def _setter(mode: str):
    @pandas_udf(StringType())
    def change(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
        return _map((doc, path, value), lambda d, p, v: _dump(assign(json.loads(d), p, _value(v), mode)))

    return change


@pandas_udf(StringType())
def json_remove(doc: pd.Series, path: pd.Series) -> pd.Series:
    return _map((doc, path), lambda d, p: _dump(remove(json.loads(d), p)))


@pandas_udf(StringType())
def json_array_append(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return _map((doc, path, value), lambda d, p, v: _dump(append(json.loads(d), p, _value(v))))


@pandas_udf(StringType())
def json_array_insert(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return _map((doc, path, value), lambda d, p, v: _dump(array_insert(json.loads(d), p, _value(v))))


@pandas_udf(StringType())
def json_merge_patch(a: pd.Series, b: pd.Series) -> pd.Series:
    return _map((a, b), lambda x, y: _dump(merge_patch(json.loads(x), json.loads(y))))


@pandas_udf(StringType())
def json_merge_preserve(a: pd.Series, b: pd.Series) -> pd.Series:
    return _map((a, b), lambda x, y: _dump(merge_preserve(json.loads(x), json.loads(y))))


@pandas_udf(IntegerType())
def json_depth(doc: pd.Series) -> pd.Series:
    return _map((doc,), lambda d: depth(json.loads(d)))


@pandas_udf(BooleanType())
def json_contains(doc: pd.Series, candidate: pd.Series) -> pd.Series:
    return _map((doc, candidate), lambda d, c: contains(json.loads(d), json.loads(c)))


FUNCTIONS = {
    "json_set": _setter("set"),
    "json_insert": _setter("insert"),
    "json_replace": _setter("replace"),
    "json_remove": json_remove,
    "json_array_append": json_array_append,
    "json_array_insert": json_array_insert,
    "json_merge_patch": json_merge_patch,
    "json_merge_preserve": json_merge_preserve,
    "json_depth": json_depth,
    "json_contains": json_contains,
}
