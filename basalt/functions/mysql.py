"""MySQL-flavoured scalar and aggregate functions as Spark expressions.

TEMPLATES maps a function's name to a Spark SQL template: {0}, {1} … are arguments, {*} all of them joined by commas. Names
that are the same built-in in Spark map to themselves. Functions with no built-in
composition are Arrow-batched Python functions, registered on a session by register().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from basalt.functions import json_paths, misc

_SAME = """
concat concat_ws octet_length bit_length upper ucase lower lcase substring substr substring_index left right ltrim rtrim
lpad rpad reverse repeat space locate instr find_in_set ascii char hex unhex bin conv quote soundex printf
regexp_like regexp_replace regexp_substr regexp_instr crc32 md5 sha sha2 abs sign ceil floor round pow power sqrt exp ln log
log2 log10 pi sin cos tan cot asin acos atan atan2 sinh cosh tanh asinh acosh atanh degrees radians rand random factorial
bit_count if ifnull nvl nullif coalesce isnull isnan typeof now curdate quarter month day dayofmonth
dayofweek weekday dayofyear hour minute second last_day user session_user collation count sum avg min max
stddev_pop stddev_samp var_pop var_samp bit_and bit_or bit_xor json_array_length year
""".split()

_NULL_IF_ANY = "CASE WHEN {any_null} THEN NULL ELSE %s({*}) END"

TEMPLATES: dict[str, str] = {name: f"{name}({{*}})" for name in _SAME} | {
    # Strings.
    "group_concat": "listagg({0}, ',')",
    "length": "octet_length({0})",
    "char_length": "char_length({0})",
    "character_length": "char_length({0})",
    "mid": "substring({0}, {1}, {2})",
    "trim": "trim({0})",
    "replace": "replace({0}, {1}, {2})",
    "position": "locate({0}, {1})",
    "insert": "CASE WHEN {1} < 1 OR {1} > char_length({0}) THEN {0} ELSE overlay({0} PLACING {3} FROM {1} FOR {2}) END",
    "field": "coalesce(array_position(array({rest}), {0}), 0)",
    "elt": "get(array({rest}), {0} - 1)",
    "make_set": "{make_set}",
    "export_set": "array_join(transform(sequence(0, 63), i -> CASE WHEN getbit(CAST({0} AS BIGINT), i) = 1 THEN {1} ELSE {2} END), ',')",
    "ord": "CASE WHEN {0} = '' THEN 0 ELSE CAST(conv(hex(encode(left({0}, 1), 'UTF-8')), 16, 10) AS BIGINT) END",
    "oct": "conv(CAST({0} AS STRING), 10, 8)",
    "difference": "aggregate(sequence(1, 4), 0, (s, i) -> s + CASE WHEN substring(soundex({0}), i, 1) = substring(soundex({1}), i, 1) THEN 1 ELSE 0 END)",
    "strcmp": "CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 WHEN {0} = {1} THEN 0 END",
    "format": "format_number({0}, {1})",
    "weight_string": "hex({0})",
    "sha1": "sha1({0})",
    "compress": "mysql_compress({0})",
    "uncompress": "mysql_uncompress({0})",
    "encrypt": "base64(aes_encrypt({0}, substring(sha2({1}, 256), 1, 32)))",
    "decode": "decode({0}, {1})",
    "snippet": "regexp_extract({0}, concat('(?is).{{0,30}}', {1}, '.{{0,30}}'), 0)",
    # Numbers.
    "truncate": "sign({0}) * floor(abs({0}) * pow(10, {1})) / pow(10, {1})",
    "trunc": "sign({0}) * floor(abs({0}) * pow(10, {1})) / pow(10, {1})",
    "mod": "try_mod({0}, {1})",
    "greatest": _NULL_IF_ANY % "greatest",
    "least": _NULL_IF_ANY % "least",
    "ceiling": "ceil({0})",
    # Conditions and conversions.
    "iif": "if({0}, {1}, {2})",
    "convert": "try_cast({0} AS {raw1})",
    # Dates and times.
    "current_timestamp": "current_timestamp()",
    "curtime": "date_format(now(), 'HH:mm:ss')",
    "utc_date": "to_date(to_utc_timestamp(now(), current_timezone()))",
    "utc_time": "date_format(to_utc_timestamp(now(), current_timezone()), 'HH:mm:ss')",
    "utc_timestamp": "to_utc_timestamp(now(), current_timezone())",
    "date": "try_cast({0} AS DATE)",
    "time": "date_format({0}, 'HH:mm:ss')",
    "timestamp": "try_cast({0} AS TIMESTAMP)",
    "datetime": "try_cast({0} AS TIMESTAMP)",
    "monthname": "date_format({0}, 'MMMM')",
    "dayname": "date_format({0}, 'EEEE')",
    "week": "(dayofyear({0}) + 7 - dayofweek({0})) div 7",
    "yearweek": "year(date_sub({0}, dayofweek({0}) - 1)) * 100 + (dayofyear(date_sub({0}, dayofweek({0}) - 1)) + 7 - dayofweek(date_sub({0}, dayofweek({0}) - 1))) div 7",
    "adddate": "date_add({0}, {1})",
    "subdate": "date_sub({0}, {1})",
    "addtime": "timestampadd(SECOND, {seconds1}, {0})",
    "subtime": "timestampadd(SECOND, -({seconds1}), {0})",
    "timestampadd": "timestampadd({raw0}, {1}, {2})",
    "timestampdiff": "timestampdiff({raw0}, {1}, {2})",
    "datediff": "datediff({0}, {1})",
    "timediff": "concat(if({0} < {1}, '-', ''), format_string('%02d:%02d:%02d', abs(timestampdiff(SECOND, {1}, {0})) div 3600, abs(timestampdiff(SECOND, {1}, {0})) div 60 % 60, abs(timestampdiff(SECOND, {1}, {0})) % 60))",
    "date_format": "date_format({0}, {pattern1})",
    "time_format": "date_format({0}, {pattern1})",
    "str_to_date": "to_date({0}, {pattern1})",
    "strftime": "date_format({1}, {pattern0})",
    # Spark puts a plus before years of five digits.
    "from_unixtime": "trim(LEADING '+' FROM from_unixtime({0}))",
    "unix_timestamp": "unix_timestamp({0})",
    "makedate": "date_add(make_date({0}, 1, 1), {1} - 1)",
    "maketime": "format_string('%02d:%02d:%02d', {0}, {1}, {2})",
    "to_days": "datediff({0}, DATE '1970-01-01') + 719528",
    "from_days": "date_add(DATE '1970-01-01', {0} - 719528)",
    "time_to_sec": "hour({0}) * 3600 + minute({0}) * 60 + second({0})",
    "sec_to_time": "format_string('%02d:%02d:%02d', {0} div 3600, {0} div 60 % 60, {0} % 60)",
    "period_add": "CAST(date_format(add_months(to_date(CAST({0} AS STRING), 'yyyyMM'), {1}), 'yyyyMM') AS INT)",
    "period_diff": "CAST(months_between(to_date(CAST({0} AS STRING), 'yyyyMM'), to_date(CAST({1} AS STRING), 'yyyyMM')) AS INT)",
    "convert_tz": "convert_timezone({1}, {2}, {0})",
    "julianday": "unix_seconds(CAST({0} AS TIMESTAMP)) / 86400.0D + 2440587.5D",
    "isdate": "try_cast({0} AS DATE) IS NOT NULL",
    # JSON.
    "json_extract": "to_json(variant_get(parse_json({0}), {1}))",
    "json_unquote": "CASE WHEN {0} LIKE '\"%\"' THEN get_json_object(concat('{{\"v\":', {0}, '}}'), '$.v') ELSE {0} END",
    "json_valid": "try_parse_json({0}) IS NOT NULL",
    "json_type": "replace(regexp_extract(schema_of_variant(parse_json({0})), '^[A-Z]+', 0), 'BIGINT', 'INTEGER')",
    "json_length": "coalesce(json_array_length({0}), size(json_object_keys({0})), 1)",
    "json_keys": "to_json(json_object_keys({0}))",
    "json_object": "to_json(map_from_entries(array({pairs})))",
    "json_array": "to_json(array({*}))",
    "json_group_array": "to_json(collect_list({0}))",
    "json_group_object": "to_json(map_from_entries(collect_list(struct({0}, {1}))))",
    "json_quote": "substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)",
    **{name: f"{name}({{*}})" for name in json_paths.FUNCTIONS},
    "json_merge": "json_merge_preserve({*})",
    "json_append": "json_array_append({*})",
    # Session and network.
    "database": "current_database()",
    "schema": "current_schema()",
    "version": "version()",
    "system_user": "current_user()",
    "inet_aton": "aggregate(transform(split({0}, '[.]'), x -> CAST(x AS BIGINT)), 0L, (a, x) -> a * 256 + x)",
    "inet_ntoa": "concat_ws('.', CAST({0} div 16777216 AS STRING), CAST({0} div 65536 % 256 AS STRING), CAST({0} div 256 % 256 AS STRING), CAST({0} % 256 AS STRING))",
    "is_ipv4": "{0} RLIKE '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'",
    "is_ipv6": "mysql_is_ipv6({0})",
    "charset": "'utf8mb4'",
    "coercibility": "4",
    "benchmark": "CASE WHEN {0} < 0 THEN NULL ELSE 0 END",
    "password": "concat('*', upper(sha1(unhex(sha1({0})))))",
    "validate_password_strength": "CASE WHEN char_length({0}) < 4 THEN 0 WHEN char_length({0}) < 8 THEN 25 ELSE 50 + if({0} RLIKE '[0-9]' AND {0} RLIKE '[a-z]' AND {0} RLIKE '[A-Z]', 25, 0) + if({0} RLIKE '[^A-Za-z0-9]', 25, 0) END",
    # Aggregates.
    "stddev": "stddev_pop({0})",
    "std": "stddev_pop({0})",
    "variance": "var_pop({0})",
}

#: MySQL date pattern letters and their Java forms (fixed values).
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "p": "a",
    "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "'%'",
}


def java_pattern(pattern: str) -> str:
    """A MySQL percent pattern as a Java date pattern; letters outside specifiers are quoted."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            out.append(PATTERNS.get(pattern[i + 1], pattern[i + 1]))
            i += 2
        else:
            out.append(f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i])
            i += 1
    return "".join(out)


def _pattern(argument: str) -> str:
    text = argument.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return '"' + java_pattern(text[1:-1].replace("''", "'")) + '"'
    return text


def _seconds(argument: str) -> str:
    return f"aggregate(transform(split({argument}, ':'), x -> CAST(x AS BIGINT)), 0L, (a, x) -> a * 60 + x)"


def expression(name: str, *args: str) -> str:
    """The Spark SQL text of a call; args are SQL texts. Unknown names are left as they are."""
    template = TEMPLATES.get(name.lower())
    if template is None:
        return f"{name}({', '.join(args)})"
    # Templates that use an argument more than once take it in parentheses.
    bound = [a if a.replace("_", "").replace(".", "").isalnum() or (a[:1] == a[-1:] == "'") else f"({a})" for a in args]
    values = {
        "*": ", ".join(args),
        "rest": ", ".join(args[1:]),
        "any_null": " OR ".join(f"{a} IS NULL" for a in bound),
        "pairs": ", ".join(f"struct({k}, {v})" for k, v in zip(args[::2], args[1::2], strict=False)),
        "make_set": f"concat_ws(',', {', '.join(f'if({bound[0]} & {1 << i} > 0, {a}, NULL)' for i, a in enumerate(args[1:]))})" if args else "",
    }
    values |= {f"raw{i}": a.strip().strip("'") for i, a in enumerate(args)}
    values |= {f"pattern{i}": _pattern(a) for i, a in enumerate(args)}
    values |= {f"seconds{i}": _seconds(a) for i, a in enumerate(args)}
    return template.format(*bound, **values)


def call(name: str, *args: str) -> Column:
    """The column of a call, with arguments given as SQL texts: call('week', 'o_orderdate')."""
    return F.expr(expression(name, *args))


def register(spark: SparkSession) -> None:
    """Register the Python-backed functions on a session, under the names that TEMPLATES use."""
    functions: dict[str, Callable] = misc.FUNCTIONS | json_paths.FUNCTIONS
    for name, function in functions.items():
        spark.udf.register(name, function)
