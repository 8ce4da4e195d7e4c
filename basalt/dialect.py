"""MySQL-flavoured SQL to Spark SQL, before Catalyst: a tokenizer and rewrites of what Spark does not take.

Rewritten: LIMIT m, n; STRAIGHT_JOIN; REGEXP; SOUNDS LIKE; <=>-free quantified comparisons (value op ANY/SOME/ALL (query)); GROUP_CONCAT with DISTINCT, ORDER BY and
SEPARATOR; INTERVAL n unit in DATE_ADD and DATE_SUB; SUBSTRING/POSITION/TRIM keyword forms; -> and ->>; and every function of the
catalogue whose Spark form differs. Strings and quoted names are never touched.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from basalt.functions.mysql import TEMPLATES, expression, register

_TOKEN = re.compile(
    r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[A-Za-z_][A-Za-z0-9_$]*|->>|->|<=>|<=|>=|<>|!=|\|\||&&|<<|>>|.",
    re.S,
)
_OPS = ("=", "<>", "!=", "<", "<=", ">", ">=")
#: Names that Spark parses itself in keyword forms, or that mean the same.
_KEEP = {"extract", "cast", "if", "left", "right", "replace", "insert", "count", "sum", "avg", "min", "max", "concat", "coalesce", "nullif", "values", "in", "exists", "date", "timestamp"}


def tokenize(sql: str) -> list[str]:
    """Tokens without comments; runs of white space are one blank."""
    out: list[str] = []
    for t in _TOKEN.findall(sql):
        if t.isspace():
            if out and out[-1] != " ":
                out.append(" ")
        elif not t.startswith(("--", "/*")) or t.startswith("/*+"):
            out.append(t)
    return out


def _skip(tokens: list[str], i: int) -> int:
    while i < len(tokens) and tokens[i] == " ":
        i += 1
    return i


def _close(tokens: list[str], i: int) -> int:
    """The place of the parenthesis that closes the one at i."""
    depth = 0
    for j in range(i, len(tokens)):
        depth += (tokens[j] == "(") - (tokens[j] == ")")
        if depth == 0:
            return j
    raise ValueError("unbalanced parentheses")


def _split(tokens: list[str]) -> list[list[str]]:
    """Arguments of a call."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if "".join(p).strip()]


def _text(tokens: list[str]) -> str:
    return "".join(tokens).strip()


def _word(tokens: list[str], word: str) -> int:
    """Where a keyword stands outside parentheses, or -1."""
    depth = 0
    for i, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.upper() == word:
            return i
    return -1


def _group_concat(body: list[str]) -> str:
    separator = "','"
    at = _word(body, "SEPARATOR")
    if at >= 0:
        separator, body = _text(body[at + 1 :]), body[:at]
    order, at = "", _word(body, "ORDER")
    if at >= 0:
        order, body = f" WITHIN GROUP ({_text(body[at:])})", body[:at]
    start = _skip(body, 0)
    distinct = "DISTINCT " if start < len(body) and body[start].upper() == "DISTINCT" else ""
    what = _text(body[start + 1 :] if distinct else body)
    return f"listagg({distinct}CAST({what} AS STRING), {separator}){order}"


def _call(name: str, body: list[str]) -> str:
    body = _rewrite(body)
    lower = name.lower()
    if lower == "group_concat":
        return _group_concat(body)
    args = _split(body)
    if lower in ("date_add", "date_sub", "adddate", "subdate") and len(args) == 2 and _text(args[1]).upper().startswith("INTERVAL"):
        return f"({_text(args[0])} {'+' if lower in ('date_add', 'adddate') else '-'} {_text(args[1])})"
    if lower in ("substring", "substr", "mid") and _word(body, "FROM") >= 0:
        return f"substring({_text(body)})"
    if lower == "position" and _word(body, "IN") >= 0:
        at = _word(body, "IN")
        return f"locate({_text(body[:at])}, {_text(body[at + 1 :])})"
    if lower == "trim" and _word(body, "FROM") >= 0:
        return _trim(body)
    if lower == "char" and len(args) > 1:
        return "concat(" + ", ".join(f"char({_text(a)})" for a in args) + ")"
    if lower == "count" or lower in _KEEP and lower not in ("insert", "date", "timestamp"):
        return f"{name}({_text(body)})"
    if lower in TEMPLATES and not (lower == "format" and not args):
        return expression(name, *map(_text, args))
    return f"{name}({_text(body)})"


def _trim(body: list[str]) -> str:
    """TRIM([BOTH|LEADING|TRAILING] remstr FROM str): remstr is a unit, not a set of characters."""
    at = _word(body, "FROM")
    head, text = [t for t in body[:at] if t != " "], _text(body[at + 1 :])
    side = head[0].upper() if head and head[0].upper() in ("BOTH", "LEADING", "TRAILING") else "BOTH"
    what = "".join(head[1:] if head and head[0].upper() == side else head) or "' '"
    quoted = f"concat('(?:', '\\\\Q', {what}, '\\\\E', ')+')"
    if side in ("BOTH", "LEADING"):
        text = f"regexp_replace({text}, concat('^', {quoted}), '')"
    if side in ("BOTH", "TRAILING"):
        text = f"regexp_replace({text}, concat({quoted}, '$'), '')"
    return text


def _quantified(value: str, op: str, word: str, query: str) -> str:
    """Three-valued ANY and ALL from one row of aggregates of the query."""
    every = word == "ALL"
    if op == "=" and not every:
        return f"{value} IN ({query})"
    if op in ("<>", "!=") and every:
        return f"{value} NOT IN ({query})"
    q = f"(SELECT {{}} FROM ({query}) AS _q(v))"
    rows, some = q.format("count(*)"), q.format("count(v)")
    if op in ("=", "<>", "!="):
        one = f"(({q.format('min(v)')}) = ({q.format('max(v)')}) AND {value} = ({q.format('min(v)')}))"
        equal = f"CASE WHEN {rows} = 0 THEN true WHEN {value} IS NULL THEN NULL WHEN {some} > 0 AND NOT {one} THEN false WHEN {some} < {rows} THEN NULL ELSE true END"
        return equal if every else f"NOT ({equal})"
    bound = "max" if (op[0] == ">") == every else "min"
    holds = f"{value} {op} {q.format(f'{bound}(v)')}"
    if every:
        return f"CASE WHEN {rows} = 0 THEN true WHEN {value} IS NULL THEN NULL WHEN {some} > 0 AND NOT ({holds}) THEN false WHEN {some} < {rows} THEN NULL ELSE true END"
    return f"CASE WHEN {rows} = 0 THEN false WHEN {value} IS NULL THEN NULL WHEN {some} > 0 AND {holds} THEN true WHEN {some} < {rows} THEN NULL ELSE false END"


def _operand(out: list[str]) -> str:
    """Takes the value before an operator off the end of out: a name, literal, call or parenthesis."""
    while out and out[-1] == " ":
        out.pop()
    taken = [out.pop()]
    if taken[0] == ")":
        depth = 1
        while depth:
            t = out.pop()
            depth += (t == ")") - (t == "(")
            taken.append(t)
        if out and re.match(r"[A-Za-z_]\w*$", out[-1]):
            taken.append(out.pop())
    while len(out) > 1 and out[-1] == ".":
        taken += [out.pop(), out.pop()]
    return "".join(reversed(taken))


def _rewrite(tokens: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        upper, nxt = t.upper(), _skip(tokens, i + 1)
        following = tokens[nxt].upper() if nxt < len(tokens) else ""
        if re.match(r"[A-Za-z_]", t) and following == "(" and (nxt == i + 1 or t.lower() in TEMPLATES) and not (out and out[-1] == ".") and upper not in ("IN", "VALUES", "AS", "ON", "AND", "OR", "NOT", "WHERE", "FROM", "USING", "OVER", "KEY", "ANY", "ALL", "SOME"):
            end = _close(tokens, nxt)
            out.append(_call(t, tokens[nxt + 1 : end]))
            i = end + 1
            continue
        if t in _OPS and following in ("ANY", "SOME", "ALL"):
            start = _skip(tokens, nxt + 1)
            end = _close(tokens, start)
            out.append(_quantified(_operand(out), t, following, _text(_rewrite(tokens[start + 1 : end]))))
            i = end + 1
            continue
        if upper == "LIMIT":
            m = re.match(r"\s*(\d+)\s*,\s*(\d+)", "".join(tokens[i + 1 :]))
            if m:
                out.append(f"LIMIT {m[2]} OFFSET {m[1]}")
                used = "".join(tokens[i + 1 :])[: m.end()]
                j, length = i + 1, 0
                while length < len(used):
                    length += len(tokens[j])
                    j += 1
                i = j
                continue
        if upper == "STRAIGHT_JOIN":
            t = "JOIN" if out and _text(out[-2:]).upper() != "SELECT" else ""
        elif upper == "REGEXP":
            t = "RLIKE"
        elif upper == "SOUNDS" and following == "LIKE":
            left = _operand(out)
            k = _skip(tokens, nxt + 1)
            out.append(f"soundex({left}) = soundex({tokens[k]})")
            i = k + 1
            continue
        elif t in ("->", "->>"):
            left = _operand(out)
            k = _skip(tokens, i + 1)
            out.append(f"get_json_object({left}, {tokens[k]})" if t == "->>" else expression("json_extract", left, tokens[k]))
            i = k + 1
            continue
        elif t == "&&":
            t = "AND"
        elif t[0] == '"' and len(t) > 1:
            t = "'" + t[1:-1].replace("'", "\\'") + "'"
        out.append(t)
        i += 1
    return out


def translate(sql: str) -> str:
    """The Spark SQL text of a MySQL-flavoured query."""
    return _text(_rewrite(tokenize(sql.strip().rstrip(";"))))


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Run a MySQL-flavoured query; args bind named parameters (:name)."""
    register(spark)
    return spark.sql(translate(sql), args=args or None)
