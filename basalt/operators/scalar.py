"""Queries over the function catalogue: each projects a family of functions over a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.mysql import expression as f
from basalt.functions.mysql import register
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import load, register_views
from basalt.sources.shared import checkpointed


def _family(name: str, section: str, table: str, key: str, columns: dict[str, tuple[str, str]]) -> None:
    """columns: alias -> (Spark SQL, oracle SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        rows = load(spark, sf_dir, table)
        return rows.selectExpr(key, *[f"{spark_sql} AS {alias}" for alias, (spark_sql, _) in columns.items()])

    oracle = ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in columns.items())
    OPERATORS[name] = Operator(run, f"SELECT {key}, {oracle} FROM {table}", section)


_I = "CAST({} AS BIGINT)".format
_S = "n_name"
#: CRC-32 bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(n_name), '..'), lambda p: ('0x' || p)::BIGINT), lambda x, y: list_reduce([xor(x, y), 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"

_family("functions_string", "2.8.1", "nation", "n_nationkey", {
    "concat_": (f("concat", _S, "'-'", _S), "concat(n_name, '-', n_name)"),
    "concat_ws_": (f("concat_ws", "','", _S, "NULL", "'z'"), "concat_ws(',', n_name, NULL, 'z')"),
    "length_": (_I(f("length", "concat(n_name, 'é')")), "octet_length(encode(n_name || 'é'))::BIGINT"),
    "char_length_": (_I(f("char_length", "concat(n_name, 'é')")), "length(n_name || 'é')::BIGINT"),
    "bit_length_": (_I(f("bit_length", _S)), "bit_length(n_name)::BIGINT"),
    "upper_": (f("upper", "lower(n_name)"), "upper(lower(n_name))"),
    "ucase_": (f("ucase", _S), "upper(n_name)"),
    "lcase_": (f("lcase", _S), "lower(n_name)"),
    "substring_": (f("substring", _S, "2", "3"), "substring(n_name, 2, 3)"),
    "mid_": (f("mid", _S, "3", "4"), "substring(n_name, 3, 4)"),
    "substring_index_": (f("substring_index", _S, "'_'", "1"), "split_part(n_name, '_', 1)"),
    "left_": (f("left", _S, "3"), "left(n_name, 3)"),
    "right_": (f("right", _S, "2"), "right(n_name, 2)"),
    "trim_": (f("trim", "concat('  ', n_name, ' ')"), "trim('  ' || n_name || ' ')"),
    "ltrim_": (f("ltrim", "concat('  ', n_name)"), "ltrim('  ' || n_name)"),
    "rtrim_": (f("rtrim", "concat(n_name, '  ')"), "rtrim(n_name || '  ')"),
    "lpad_": (f("lpad", _S, "12", "'*'"), "lpad(n_name, 12, '*')"),
    "rpad_": (f("rpad", _S, "12", "'*'"), "rpad(n_name, 12, '*')"),
    "replace_": (f("replace", _S, "'NATION'", "'N'"), "replace(n_name, 'NATION', 'N')"),
    "reverse_": (f("reverse", _S), "reverse(n_name)"),
    "repeat_": (f("repeat", _S, "2"), "repeat(n_name, 2)"),
    "space_": (f("space", "3"), "'   '"),
    "position_": (_I(f("position", "'_'", _S)), "position('_' IN n_name)::BIGINT"),
    "locate_": (_I(f("locate", "'N'", _S, "2")), "(CASE WHEN instr(substr(n_name, 2), 'N') = 0 THEN 0 ELSE instr(substr(n_name, 2), 'N') + 1 END)::BIGINT"),
    "instr_": (_I(f("instr", _S, "'T'")), "instr(n_name, 'T')::BIGINT"),
    "insert_": (f("insert", _S, "2", "3", "'xx'"), "left(n_name, 1) || 'xx' || substr(n_name, 5)"),
    "field_": (_I(f("field", _S, "'NATION_1'", "'NATION_2'")), "(CASE n_name WHEN 'NATION_1' THEN 1 WHEN 'NATION_2' THEN 2 ELSE 0 END)::BIGINT"),
    "find_in_set_": (_I(f("find_in_set", _S, "'NATION_3,NATION_4'")), "(CASE n_name WHEN 'NATION_3' THEN 1 WHEN 'NATION_4' THEN 2 ELSE 0 END)::BIGINT"),
    "elt_": (f("elt", "n_regionkey", "'a'", "'b'", "'c'"), "CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END"),
    "make_set_": (f("make_set", "n_regionkey", "'a'", "'b'", "'c'"), "concat_ws(',', CASE WHEN n_regionkey & 1 > 0 THEN 'a' END, CASE WHEN n_regionkey & 2 > 0 THEN 'b' END, CASE WHEN n_regionkey & 4 > 0 THEN 'c' END)"),
    "export_set_": (f("left", f("export_set", "n_regionkey", "'Y'", "'N'"), "5"), "array_to_string(list_transform([0, 1, 2], lambda i: CASE WHEN (n_regionkey >> i) & 1 = 1 THEN 'Y' ELSE 'N' END), ',')"),
    "ascii_": (_I(f("ascii", _S)), "ascii(n_name)::BIGINT"),
    "ord_": (_I(f("ord", "'é'")), "50089::BIGINT"),
    "char_": (f("char", "65 + n_regionkey"), "chr(65 + n_regionkey)"),
    "hex_": (f("hex", _S), "hex(n_name)"),
    "bin_": (f("bin", "n_nationkey"), "bin(n_nationkey)"),
    "oct_": (f("oct", "n_nationkey"), "CASE WHEN n_nationkey < 8 THEN n_nationkey::VARCHAR ELSE (n_nationkey // 8)::VARCHAR || (n_nationkey % 8)::VARCHAR END"),
    "conv_": (f("conv", "CAST(n_nationkey AS STRING)", "10", "16"), "upper(printf('%x', n_nationkey))"),
    "strcmp_": (_I(f("strcmp", _S, "'NATION_2'")), "(CASE WHEN n_name < 'NATION_2' THEN -1 WHEN n_name > 'NATION_2' THEN 1 ELSE 0 END)::BIGINT"),
    "soundex_": (f("soundex", "'Robert'"), "'R163'"),
    "difference_": (_I(f("difference", "'Robert'", "'Rupert'")), "4::BIGINT"),
    "format_": (f("format", "n_nationkey * 1234.5D", "2"), "format('{:,.2f}', n_nationkey * 1234.5)"),
    "regexp_like_": (f("regexp_like", _S, "'_1[0-9]'"), "regexp_matches(n_name, '_1[0-9]')"),
    "regexp_replace_": (f("regexp_replace", _S, "'[0-9]+'", "'#'"), "regexp_replace(n_name, '[0-9]+', '#', 'g')"),
    "regexp_substr_": (f("regexp_substr", _S, "'[0-9]+'"), "regexp_extract(n_name, '[0-9]+')"),
    "regexp_instr_": (_I(f("regexp_instr", _S, "'[0-9]'")), "instr(n_name, regexp_extract(n_name, '[0-9]'))::BIGINT"),
    "md5_": (f("md5", _S), "md5(n_name)"),
    "sha1_": (f("sha1", _S), "sha1(n_name)"),
    "sha2_": (f("sha2", _S, "256"), "sha256(n_name)"),
    "round_trip_": (f("uncompress", f("compress", _S)), "n_name"),
    "unhex_": ("CAST(" + f("unhex", "'616263'") + " AS STRING)", "'abc'"),
    "quote_": (f("quote", _S), "'''' || n_name || ''''"),
    "snippet_": (f("snippet", _S, "'tion'"), "n_name"),
    "octet_length_": (_I(f("octet_length", "concat(n_name, 'é')")), "octet_length(encode(n_name || 'é'))::BIGINT"),
    "substr_": (f("substr", _S, "2", "n_regionkey"), "substring(n_name, 2, n_regionkey)"),
    "printf_": (f("printf", "'%s-%03d'", _S, "n_nationkey"), "printf('%s-%03d', n_name, n_nationkey)"),
    "weight_string_": (f("weight_string", _S), "hex(n_name)"),
    "crc32_": (f("crc32", _S), _CRC),
    "sha_": (f("sha", _S), "sha1(n_name)"),
    "encrypt_": ("CAST(aes_decrypt(unbase64(" + f("encrypt", _S, "'key'") + "), substring(sha2('key', 256), 1, 32)) AS STRING)", "n_name"),
    "decode_": (f("decode", "encode(n_name, 'UTF-8')", "'UTF-8'"), "n_name"),
})

_X = "c_acctbal"
_family("functions_numeric", "2.8.2", "customer", "c_custkey", {
    "abs_": (f("abs", _X), "abs(c_acctbal)"),
    "sign_": ("CAST(" + f("sign", _X) + " AS BIGINT)", "sign(c_acctbal)::BIGINT"),
    "ceil_": (_I(f("ceil", _X)), "ceil(c_acctbal)::BIGINT"),
    "floor_": (_I(f("floor", _X)), "floor(c_acctbal)::BIGINT"),
    "truncate_": ("round(" + f("truncate", _X, "1") + ", 1)", "round(sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10, 1)"),
    "mod_": (f("mod", "c_custkey", "7"), "c_custkey % 7"),
    "mod_zero_": (f("mod", "c_custkey", "c_custkey - c_custkey"), "c_custkey % nullif(0, 0)"),
    "pow_": ("round(" + f("pow", "c_nationkey", "2") + ", 6)", "round(pow(c_nationkey, 2), 6)"),
    "sqrt_": ("round(" + f("sqrt", "abs(c_acctbal)") + ", 8)", "round(sqrt(abs(c_acctbal)), 8)"),
    "exp_": ("round(" + f("exp", "c_nationkey / 10D") + ", 8)", "round(exp(c_nationkey / 10.0::DOUBLE), 8)"),
    "ln_": ("round(" + f("ln", "c_custkey + 1") + ", 8)", "round(ln(c_custkey + 1), 8)"),
    "log_": ("round(" + f("log", "2", "c_custkey + 1") + ", 8)", "round(ln(c_custkey + 1) / ln(2), 8)"),
    "log2_": ("round(" + f("log2", "c_custkey + 1") + ", 8)", "round(log2(c_custkey + 1), 8)"),
    "log10_": ("round(" + f("log10", "c_custkey + 1") + ", 8)", "round(log10(c_custkey + 1), 8)"),
    "pi_": ("round(" + f("pi") + ", 8)", "round(pi(), 8)"),
    "trig_": ("round(" + f("sin", "c_nationkey") + " + " + f("cos", "c_nationkey") + " + " + f("tan", "c_nationkey") + ", 8)", "round(sin(c_nationkey) + cos(c_nationkey) + tan(c_nationkey), 8)"),
    "cot_": ("round(" + f("cot", "c_nationkey + 1") + ", 8)", "round(cot(c_nationkey + 1), 8)"),
    "arc_": ("round(" + f("asin", "c_nationkey / 25D") + " + " + f("acos", "c_nationkey / 25D") + " + " + f("atan", "c_nationkey") + " + " + f("atan2", "c_nationkey", "2") + ", 8)", "round(asin(c_nationkey / 25.0) + acos(c_nationkey / 25.0) + atan(c_nationkey) + atan2(c_nationkey, 2), 8)"),
    "hyper_": ("round(" + f("sinh", "c_nationkey / 9D") + " + " + f("cosh", "c_nationkey / 9D") + " + " + f("tanh", "c_nationkey") + ", 8)", "round(sinh(c_nationkey / 9.0) + cosh(c_nationkey / 9.0) + tanh(c_nationkey), 8)"),
    "arc_hyper_": ("round(" + f("asinh", "c_nationkey") + " + " + f("acosh", "c_nationkey + 1") + " + " + f("atanh", "c_nationkey / 26D") + ", 8)", "round(asinh(c_nationkey) + acosh(c_nationkey + 1) + atanh(c_nationkey / 26.0), 8)"),
    "degrees_": ("round(" + f("degrees", "c_nationkey") + ", 8)", "round(degrees(c_nationkey), 8)"),
    "radians_": ("round(" + f("radians", "c_nationkey") + ", 8)", "round(radians(c_nationkey), 8)"),
    "greatest_": (f("greatest", "c_nationkey", "nullif(c_nationkey, 3)", "5"), "CASE WHEN c_nationkey = 3 THEN NULL ELSE greatest(c_nationkey, 5) END"),
    "least_": (f("least", "c_nationkey", "nullif(c_nationkey, 3)", "5"), "CASE WHEN c_nationkey = 3 THEN NULL ELSE least(c_nationkey, 5) END"),
    "factorial_": (_I(f("factorial", "c_nationkey % 20")), "factorial(c_nationkey % 20)::BIGINT"),
    "bit_count_": (_I(f("bit_count", "c_custkey")), "bit_count(c_custkey)::BIGINT"),
    "div_": ("c_custkey div 7", "c_custkey // 7"),
    "trunc_": ("round(" + f("trunc", _X, "-1") + ", 1)", "round(sign(c_acctbal) * floor(abs(c_acctbal) / 10) * 10, 1)"),
    "power_": ("round(" + f("power", "c_nationkey", "3") + ", 6)", "round(pow(c_nationkey, 3), 6)"),
    "rand_": (f("rand") + " + c_nationkey BETWEEN c_nationkey AND c_nationkey + 1", "true"),
    "random_": (f("random") + " < 1 + c_nationkey", "true"),
    "ceiling_": (_I(f("ceiling", _X)), "ceil(c_acctbal)::BIGINT"),
})

_family("functions_conditional", "2.8.3", "customer", "c_custkey", {
    "iif_": (f("iif", "c_acctbal > 0", "'in'", "'out'"), "CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END"),
    "ifnull_": (f("ifnull", "nullif(c_nationkey, 4)", "-1"), "coalesce(nullif(c_nationkey, 4), -1)"),
    "nvl_": (f("nvl", "nullif(c_nationkey, 4)", "-1"), "coalesce(nullif(c_nationkey, 4), -1)"),
    "nullif_": (f("nullif", "c_nationkey", "4"), "nullif(c_nationkey, 4)"),
    "coalesce_": (f("coalesce", "nullif(c_nationkey, 4)", "nullif(c_nationkey, 5)", "0"), "coalesce(nullif(c_nationkey, 4), nullif(c_nationkey, 5), 0)"),
    "isnull_": (f("isnull", "nullif(c_nationkey, 4)"), "nullif(c_nationkey, 4) IS NULL"),
    "isnan_": (f("isnan", "c_acctbal"), "isnan(c_acctbal)"),
    "try_cast_": ("try_cast(c_name AS INT)", "try_cast(c_name AS INT)"),
    "convert_": (f("convert", "c_custkey", "string"), "c_custkey::VARCHAR"),
    "typeof_": (f("typeof", "c_acctbal") + " || c_nationkey", "'double' || c_nationkey"),
})

_D, _T = "CAST(o_orderdate AS DATE)", "(o_orderdate + INTERVAL 3723 SECOND)"
_family("functions_datetime", "2.8.4", "orders", "o_orderkey", {
    "date_": (f("date", "o_orderdate"), "o_orderdate::DATE"),
    "year_": (_I(f("year", "o_orderdate")), "year(o_orderdate)::BIGINT"),
    "quarter_": (_I(f("quarter", "o_orderdate")), "quarter(o_orderdate)::BIGINT"),
    "month_": (_I(f("month", "o_orderdate")), "month(o_orderdate)::BIGINT"),
    "monthname_": (f("monthname", "o_orderdate"), "monthname(o_orderdate)"),
    "dayname_": (f("dayname", "o_orderdate"), "dayname(o_orderdate)"),
    "day_": (_I(f("day", "o_orderdate")), "day(o_orderdate)::BIGINT"),
    "dayofweek_": (_I(f("dayofweek", "o_orderdate")), "(dayofweek(o_orderdate) + 1)::BIGINT"),
    "weekday_": (_I(f("weekday", "o_orderdate")), "(isodow(o_orderdate) - 1)::BIGINT"),
    "dayofyear_": (_I(f("dayofyear", "o_orderdate")), "dayofyear(o_orderdate)::BIGINT"),
    "week_": (_I(f("week", "o_orderdate")), "((dayofyear(o_orderdate) + 6 - dayofweek(o_orderdate)) // 7)::BIGINT"),
    "yearweek_": (_I(f("yearweek", _D)), "(year(o_orderdate::DATE - dayofweek(o_orderdate)::INT) * 100 + (dayofyear(o_orderdate::DATE - dayofweek(o_orderdate)::INT) + 6) // 7)::BIGINT"),
    "hour_": (_I(f("hour", _T)), "hour(o_orderdate + INTERVAL 3723 SECOND)::BIGINT"),
    "minute_": (_I(f("minute", _T)), "minute(o_orderdate + INTERVAL 3723 SECOND)::BIGINT"),
    "second_": (_I(f("second", _T)), "second(o_orderdate + INTERVAL 3723 SECOND)::BIGINT"),
    "adddate_": (f("adddate", _D, "10"), "o_orderdate::DATE + 10"),
    "subdate_": (f("subdate", _D, "10"), "o_orderdate::DATE - 10"),
    "datediff_": (_I(f("datediff", "o_orderdate", "DATE '1995-01-01'")), "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT"),
    "timestampdiff_": (_I(f("timestampdiff", "DAY", "TIMESTAMP_NTZ '1995-01-01 00:00:00'", "o_orderdate")), "date_sub('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT"),
    "timestampadd_": (f("timestampadd", "HOUR", "5", "o_orderdate"), "o_orderdate + INTERVAL 5 HOUR"),
    "addtime_": (f("addtime", "o_orderdate", "'01:02:03'"), "o_orderdate + INTERVAL 3723 SECOND"),
    "subtime_": (f("subtime", "o_orderdate", "'00:00:10'"), "o_orderdate - INTERVAL 10 SECOND"),
    "date_format_": (f("date_format", "o_orderdate", "'%Y-%m-%d %H:%i:%s'"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
    "time_format_": (f("time_format", _T, "'%H:%i'"), "strftime(o_orderdate + INTERVAL 3723 SECOND, '%H:%M')"),
    "str_to_date_": (f("str_to_date", "date_format(o_orderdate, 'dd/MM/yyyy')", "'%d/%m/%Y'"), "o_orderdate::DATE"),
    "strftime_": (f("strftime", "'%Y%m'", "o_orderdate"), "strftime(o_orderdate, '%Y%m')"),
    "last_day_": (f("last_day", "o_orderdate"), "last_day(o_orderdate)"),
    "makedate_": (f("makedate", "year(o_orderdate)", "32"), "make_date(year(o_orderdate), 2, 1)"),
    "maketime_": (f("maketime", "1", "2", "3"), "'01:02:03'"),
    "to_days_": (_I(f("to_days", "o_orderdate")), "(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528)::BIGINT"),
    "from_days_": (f("from_days", "739265"), "DATE '2024-01-15'"),
    "time_to_sec_": (_I(f("time_to_sec", _T)), "(hour(o_orderdate + INTERVAL 3723 SECOND) * 3600 + minute(o_orderdate + INTERVAL 3723 SECOND) * 60 + second(o_orderdate + INTERVAL 3723 SECOND))::BIGINT"),
    "sec_to_time_": (f("sec_to_time", "3661"), "'01:01:01'"),
    "period_add_": (_I(f("period_add", "202401", "14")), "202503::BIGINT"),
    "period_diff_": (_I(f("period_diff", "202403", "202401")), "2::BIGINT"),
    "julianday_": ("round(" + f("julianday", "o_orderdate") + ", 5)", "round(epoch(o_orderdate) / 86400.0 + 2440587.5, 5)"),
    "isdate_": (f("isdate", "o_orderpriority"), "try_cast(o_orderpriority AS DATE) IS NOT NULL"),
    "dayofmonth_": (_I(f("dayofmonth", "o_orderdate")), "day(o_orderdate)::BIGINT"),
    "time_": (f("time", _T), "strftime(o_orderdate + INTERVAL 3723 SECOND, '%H:%M:%S')"),
    "timestamp_": ("CAST(" + f("timestamp", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')") + " AS TIMESTAMP_NTZ)", "o_orderdate"),
    "datetime_": ("CAST(" + f("datetime", "date_format(o_orderdate, 'yyyy-MM-dd')") + " AS TIMESTAMP_NTZ)", "date_trunc('day', o_orderdate)::TIMESTAMP"),
    "timediff_": (f("timediff", "o_orderdate", _T), "'-01:02:03'"),
    "from_unixtime_": (f("from_unixtime", "o_orderkey * 86399"), "strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S')"),
    "unix_timestamp_": (f("unix_timestamp", "o_orderdate"), "epoch(o_orderdate)::BIGINT"),
    "convert_tz_": (f("convert_tz", "o_orderdate", "'UTC'", "'Asia/Tokyo'"), "o_orderdate + INTERVAL 9 HOUR"),
    "now_": (f("now") + " > CAST(o_orderdate AS TIMESTAMP)", "true"),
    "current_timestamp_": (f("current_timestamp") + " > CAST(o_orderdate AS TIMESTAMP)", "true"),
    "curdate_": (f("curdate") + " > o_orderdate", "true"),
    "curtime_": (f("curtime") + " RLIKE '^[0-2][0-9](:[0-5][0-9]){2}$'", "true"),
    "utc_date_": (f("utc_date") + " > o_orderdate", "true"),
    "utc_time_": (f("utc_time") + " RLIKE '^[0-2][0-9](:[0-5][0-9]){2}$'", "true"),
    "utc_timestamp_": (f("utc_timestamp") + " > CAST(o_orderdate AS TIMESTAMP)", "true"),
})

_J = "props"
_family("functions_json", "2.8.5", "events", "event_id", {
    "extract_": (f("json_extract", _J, "'$.k'"), "CAST(json_extract(props, '$.k') AS VARCHAR)"),
    "unquoted_": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
    "valid_": (f("json_valid", _J), "json_valid(props)"),
    "type_": (f("json_type", _J), "json_type(props)"),
    "length_": (_I(f("json_length", _J)), "length(json_keys(props))::BIGINT"),
    "keys_": (f("json_keys", _J), "CAST(to_json(json_keys(props)) AS VARCHAR)"),
    "array_": (f("json_array", "event_id", "user_id"), "CAST(json_array(event_id, user_id) AS VARCHAR)"),
    "object_": (f("json_object", "'id'", "event_id"), "CAST(json_object('id', event_id) AS VARCHAR)"),
    "quote_": (f("json_quote", "event_type"), "'\"' || event_type || '\"'"),
    "set_": (f("json_set", _J, "'$.z'", "'1'"), "'{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}'"),
    "insert_": (f("json_insert", _J, "'$.k'", "'1'"), "'{\"k\":' || json_extract_string(props, '$.k') || '}'"),
    "replace_": (f("json_replace", _J, "'$.k'", "'1'"), "'{\"k\":1}'"),
    "remove_": (f("json_remove", _J, "'$.k'"), "'{}'"),
    "patch_": (f("json_merge_patch", _J, "'{\"k\":null,\"a\":[1]}'"), "'{\"a\":[1]}'"),
    "preserve_": (f("json_merge_preserve", "'[1]'", "'[2]'"), "'[1,2]'"),
    "append_": (f("json_array_append", "'[1]'", "'$'", "'2'"), "'[1,2]'"),
    "array_insert_": (f("json_array_insert", "'[1,3]'", "'$[1]'", "'2'"), "'[1,2,3]'"),
    "depth_": (_I(f("json_depth", _J)), "2::BIGINT"),
    "contains_": (f("json_contains", "'[1,2]'", "'2'"), "true"),
    "contains_column_": (f("json_contains", "to_json(array(event_id, 7))", "CAST(user_id AS STRING)"), "user_id IN (event_id, 7)"),
    "json_unquote_": (f("json_unquote", f("json_quote", "event_type")), "event_type"),
    "array_length_": (_I(f("json_array_length", "to_json(array_repeat(event_id, CAST(user_id % 5 AS INT)))")), "(user_id % 5)::BIGINT"),
    "merge_": (f("json_merge", "to_json(array(event_id))", "to_json(array(user_id, 2))"), "'[' || event_id || ',' || user_id || ',2]'"),
    "preserve_column_": (f("json_merge_preserve", _J, "to_json(named_struct('k', user_id))"), "'{\"k\":[' || json_extract_string(props, '$.k') || ',' || user_id || ']}'"),
    "append_column_": (f("json_append", "to_json(array(event_id))", "'$'", "CAST(user_id AS STRING)"), "'[' || event_id || ',' || user_id || ']'"),
    "insert_column_": (f("json_array_insert", "to_json(array(event_id, user_id))", "'$[1]'", "'5'"), "'[' || event_id || ',5,' || user_id || ']'"),
    "set_column_": (f("json_set", _J, "'$.k'", "CAST(user_id AS STRING)"), "'{\"k\":' || user_id || '}'"),
})

_family("functions_network", "2.8.6", "nation", "n_nationkey", {
    "aton_": (f("inet_aton", "concat('10.0.', CAST(n_regionkey AS STRING), '.', CAST(n_nationkey AS STRING))"), "(167772160 + n_regionkey * 256 + n_nationkey)::BIGINT"),
    "ntoa_": (f("inet_ntoa", "167772160 + n_nationkey"), "'10.0.0.' || n_nationkey"),
    "v4_": (f("is_ipv4", "concat('10.0.0.', CAST(n_nationkey * 20 AS STRING))"), "n_nationkey * 20 <= 255"),
    "v6_": (f("is_ipv6", "'2001:db8::1'"), "true"),
    "charset_": (f("charset", "n_name"), "'utf8mb4'"),
    "benchmark_": (_I(f("benchmark", "10", "n_name")), "0::BIGINT"),
    "password_": (f("length", f("password", "n_name")), "41"),
    "database_": (f("database") + " || n_name", "'default' || n_name"),
    "schema_": (f("schema") + " || n_name", "'default' || n_name"),
    "version_": ("length(" + f("version") + ") > 0 AND n_nationkey >= 0", "true"),
    "users_": (f"{f('user')} = {f('session_user')} AND {f('user')} = {f('system_user')} AND n_nationkey >= 0", "true"),
    "collation_": (f("collation", _S) + " LIKE '%UTF8_BINARY'", "true"),
    "coercibility_": (_I(f("coercibility", _S)), "4::BIGINT"),
    "strength_": (_I(f("validate_password_strength", "n_name")), "(CASE WHEN length(n_name) < 8 THEN 25 ELSE 75 END)::BIGINT"),
})


def _aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "nation", "customer")
    return spark.sql(
        f"SELECT c_nationkey, round({f('stddev', 'c_acctbal')}, 6) AS sd, round({f('variance', 'c_acctbal')}, 4) AS var, "
        f"array_join(array_sort(from_json({f('json_group_array', 'c_mktsegment')}, 'array<string>')), ',') AS segments, "
        f"get_json_object({f('json_group_object', 'c_name', 'c_custkey')}, concat('$.', min(c_name))) AS first FROM customer GROUP BY c_nationkey"
    )


OPERATORS["functions_aggregate"] = Operator(
    _aggregates,
    "SELECT c_nationkey, round(stddev_pop(c_acctbal), 6) AS sd, round(var_pop(c_acctbal), 4) AS var, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, arg_min(c_custkey, c_name)::VARCHAR AS first FROM customer GROUP BY c_nationkey",
    "2.8.7",
)


def json_each(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, key and value (JSON text) of the top-level members of a JSON column; elements of arrays have their place as key."""
    rows.createOrReplaceTempView("_json_each")
    named = ", ".join(f"t.{k}" for k in keys)
    return rows.sparkSession.sql(f"SELECT {named}, coalesce(e.key, CAST(e.pos AS STRING)) AS key, to_json(e.value) AS value FROM _json_each t, LATERAL variant_explode(parse_json(t.{column})) e")


def json_tree(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, path, depth, type and value (JSON text) of every node of a JSON column, the root at depth 0; levels are opened one after the other."""
    level = rows.select(*keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.parse_json(column).alias("v"))
    found = None
    while True:
        level = checkpointed(level.select(*keys, "path", "depth", F.to_json("v").alias("value")))
        if level.isEmpty():
            return found if found is not None else level.withColumn("type", F.lit(""))
        kind = F.when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array").when(F.col("value").startswith('"'), "text")
        kind = kind.when(F.col("value").isin("true", "false"), "boolean").when(F.col("value") == "null", "null").otherwise("number")
        part = level.withColumn("type", kind)
        found = part if found is None else found.unionByName(part)
        part.filter("type IN ('object', 'array')").createOrReplaceTempView("_json_level")
        named = ", ".join(f"t.{k}" for k in keys)
        level = rows.sparkSession.sql(f"SELECT {named}, concat(t.path, if(t.type = 'array', concat('[', e.pos, ']'), concat('.', e.key))) AS path, t.depth + 1 AS depth, e.value AS v FROM _json_level t, LATERAL variant_explode(parse_json(t.value)) e")


_NESTED = "event_id, concat('{\"id\":', event_id, ',\"tags\":[\"', event_type, '\",', props, ',null]}') AS doc"
OPERATORS["json_each"] = Operator(
    lambda spark, d: json_each(load(spark, d, "events").selectExpr(*_NESTED.split(", ", 1)), "doc", "event_id"),
    "SELECT event_id, unnest(['id', 'tags']) AS key, unnest([event_id::VARCHAR, '[\"' || event_type || '\",' || replace(props, ' ', '') || ',null]']) AS value FROM events",
    "2.8.5",
)
OPERATORS["json_tree"] = Operator(
    lambda spark, d: json_tree(load(spark, d, "events").selectExpr(*_NESTED.split(", ", 1)), "doc", "event_id").select("event_id", "path", "depth", "type"),
    "SELECT event_id, unnest(['$', '$.id', '$.tags', '$.tags[0]', '$.tags[1]', '$.tags[2]', '$.tags[1].k']) AS path, unnest([0, 1, 1, 2, 2, 2, 3]) AS depth, unnest(['object', 'number', 'array', 'text', 'object', 'null', 'number']) AS type FROM events",
    "2.8.5",
)
