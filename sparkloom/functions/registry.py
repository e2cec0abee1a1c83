"""Functions of the semantic SQL dialect in terms of Spark's own.

A call whose name means the same in Spark stays as it is. The others have a template here: ``{0}``,
``{1}`` are arguments, ``{*}`` all of them, and a number of arguments may pick a variant.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession

from sparkloom.plans.dialect import to_spark
from sparkloom.plans.exprs import Token, tokens

_SUM = "aggregate({}, 0D, (z_acc, z_e) -> z_acc + z_e)"
_DOT = _SUM.format("zip_with({0}, {1}, (z_p, z_q) -> cast(z_p AS double) * z_q)")
_NORM = "sqrt(" + _SUM.format("transform({%d}, z_e -> cast(z_e AS double) * z_e)") + ")"
_L2 = "sqrt(" + _SUM.format("zip_with({0}, {1}, (z_p, z_q) -> (cast(z_p AS double) - z_q) * (cast(z_p AS double) - z_q))") + ")"
_V = "parse_json({0})"
#: A range that is empty where its step leads away from the end.
_STEPS = "if(({0} + {2} > {0} AND {0} <= {1}) OR ({0} + {2} < {0} AND {0} >= {1}), sequence({0}, if(({0} + {2} > {0}) = ({0} <= {1}), {1}, {0}), {2}), array())"
_UP = "if({0} <= {1}, sequence({0}, greatest({0}, {1})), array())"
#: The first match alone: what follows the place where it begins, replaced at its start.
_FIRST = (
    "CASE WHEN regexp_instr({0}, {1}) = 0 THEN {0} ELSE concat(substr({0}, 1, regexp_instr({0}, {1}) - 1), "
    "regexp_replace(substr({0}, regexp_instr({0}, {1})), concat('\\\\A(?:', {1}, ')'), {2})) END"
)
#: Microseconds of a day-time interval.
_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp_ntz'1970-01-01 00:00:00' + {0})"
_DAY = "86400000000"
_REST = f"cast({_MICROS} % {_DAY} div 3600000000 AS int), cast({_MICROS} % 3600000000 div 60000000 AS int), cast({_MICROS} % 60000000 AS decimal(18, 6)) / 1000000)"
_HOURS = f"make_interval(0, 0, 0, cast({_MICROS} div {_DAY} AS int), {_REST}"
_MONTHS = f"make_interval(0, cast({_MICROS} div {_DAY} div 30 AS int), 0, cast({_MICROS} div {_DAY} % 30 AS int), {_REST}"


def _groups(pattern: str) -> int:
    """Capturing groups of a quoted pattern; 0 if it isn't a literal."""
    if not (pattern.startswith("'") and pattern.endswith("'")):
        return 0
    bare = re.sub(r"\\\\.|\[[^\]]*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _regexp_match(args: list[str]) -> str:
    """The groups of the first match, or the whole match if the pattern has none."""
    text, pattern = _operand(args[0]), _operand(args[1])
    if len(args) > 2:
        pattern = f"concat('(?', replace({args[2]}, 'g', ''), ')', {pattern})"
    n = _groups(args[1])
    found = ", ".join(f"regexp_extract({text}, {pattern}, {k})" for k in (range(1, n + 1) if n else (0,)))
    return f"CASE WHEN {text} RLIKE {pattern} THEN array({found}) END"


def _regexp_replace(args: list[str]) -> str:
    """The first match, or with the flag g all of them; ``\\1`` and ``$1`` are groups. Other flags are the pattern's."""
    text, pattern, new = map(_operand, args[:3])
    new = f"regexp_replace({new}, '\\\\\\\\([0-9])', '\\\\$$1')"
    if len(args) > 3:
        pattern = f"concat(if(replace({args[3]}, 'g', '') = '', '', concat('(?', replace({args[3]}, 'g', ''), ')')), {pattern})"
    first = _fill(_FIRST, [text, pattern, new])
    return first if len(args) < 4 else f"CASE WHEN contains({args[3]}, 'g') THEN regexp_replace({text}, {pattern}, {new}) ELSE {first} END"


_ARRAYS = re.compile(r"(?i)\s*(?:make_array|array|sequence|filter|transform|split|slice|array_(?!to_string|position\b|length|has|empty|ndims|any_value|first|last|element|max|min|distance)\w+|if\(.*sequence)\s*\(")


def _concat(args: list[str]) -> str:
    """Arrays one after the other if an argument is written as an array; else texts, nulls left out."""
    if any(_ARRAYS.match(a) for a in args):
        return f"concat({', '.join(args)})"
    return f"concat_ws('', {', '.join(args)})"


def _date_part(args: list[str]) -> str:
    """Days of the week count from 0, Sunday."""
    if args[0].strip().strip("'").lower() in ("dow", "dayofweek"):
        return f"(dayofweek({args[1]}) - 1)"
    return f"date_part({', '.join(args)})"

_PATH = "try_variant_get(parse_json({0}), '$', '%s')"

def _quantiles(args: list[str]) -> str:
    """The n + 1 bounds of n equal parts; n is a number."""
    n = int(args[1])
    return f"approx_percentile({args[0]}, array({', '.join(f'{k / n}D' for k in range(n + 1))}))"


SCALAR: dict[str, str | dict[int, str] | Callable[[list[str]], str]] = {
    # conditionals, types
    "arrow_cast": "cast({0} AS {1:type})", "arrow_typeof": "typeof({0})", "get_field": "{0}[{1}]",
    "union_extract": "variant_get(parse_json({0}), concat('$.', {1}), 'string')", "union_tag": f"schema_of_variant({_V})",
    # hashes
    "digest": "sha2({0}, cast(regexp_extract({1}, '([0-9]+)$', 1) AS int))", "sha224": "sha2({0}, 224)",
    "sha256": "sha2({0}, 256)", "sha384": "sha2({0}, 384)", "sha512": "sha2({0}, 512)", "farm_fingerprint": "xxhash64({0})",
    # dates and times
    "date_bin": "timestamp_micros(unix_micros(cast({1} AS timestamp)) - pmod(unix_micros(cast({1} AS timestamp)), unix_micros(timestamp'1970-01-01 00:00:00Z' + {0})))",
    "date_part": _date_part, "datepart": _date_part,
    "justify_hours": _HOURS, "justify_days": _MONTHS, "justify_interval": _MONTHS,
    "from_unixtime": "timestamp_seconds({0})", "to_char": "date_format({0}, {1})", "to_local_time": "to_timestamp_ntz({0})",
    "to_unixtime": "unix_seconds(cast({0} AS timestamp))", "to_timestamp_seconds": "timestamp_seconds({0})", "to_timestamp_millis": "timestamp_millis({0})",
    "to_timestamp_micros": "timestamp_micros({0})", "to_timestamp_nanos": "timestamp_micros({0} div 1000)",
    "format_date": "date_format({1}, {0:strftime})", "format_timestamp": "date_format({1}, {0:strftime})",
    "format_datetime": "date_format({1}, {0:strftime})", "format_time": "date_format(cast(concat('1970-01-01 ', cast({1} AS string)) AS timestamp_ntz), {0:strftime})",
    "parse_date": "to_date({1}, {0:strftime})", "parse_timestamp": "to_timestamp({1}, {0:strftime})",
    "parse_datetime": "to_timestamp_ntz({1}, {0:strftime})", "parse_time": "to_time({1}, {0:strftime})",
    "current_datetime": "localtimestamp()", "timestamp_trunc": "date_trunc('{1:word}', {0})", "datetime_trunc": "date_trunc('{1:word}', to_timestamp_ntz({0}))",
    "time_trunc": "time_trunc('{1:word}', {0})", "timestamp_diff": "timestampdiff({2:word}, {1}, {0})",
    "datetime_diff": "timestampdiff({2:word}, {1}, {0})", "time_diff": "time_diff('{2:word}', {1}, {0})",
    "timestamp_add": "({0} + {1})", "timestamp_sub": "({0} - {1})", "datetime_add": "(to_timestamp_ntz({0}) + {1})",
    "datetime_sub": "(to_timestamp_ntz({0}) - {1})", "time_add": "({0} + {1})", "time_sub": "({0} - {1})",
    "datetime": "to_timestamp_ntz({0})", "generate_date_array": {2: _UP, 3: _STEPS},
    "generate_timestamp_array": _STEPS, "time": {1: "to_time({0})", 3: "make_time({0}, {1}, {2})"},
    # text encodings
    "encode": "CASE lower({1}) WHEN 'hex' THEN lower(hex({0})) ELSE base64({0}) END",
    "decode": {2: "CASE lower({1}) WHEN 'hex' THEN unhex({0}) ELSE unbase64({0}) END"},
    "from_base64": "unbase64({0})", "to_base64": "base64({0})", "from_hex": "unhex({0})", "to_hex": "lower(hex({0}))",
    "from_base32": "sparkloom_from_base32({0})", "to_base32": "sparkloom_to_base32({0})",
    "normalize": {1: "sparkloom_normalize({0}, 'NFC')", 2: "sparkloom_normalize({0}, '{1:word}')"},
    "normalize_and_casefold": {1: "sparkloom_casefold({0}, 'NFC')", 2: "sparkloom_casefold({0}, '{1:word}')"},
    # numbers
    "gcd": "sparkloom_gcd({0}, {1})", "lcm": "sparkloom_lcm({0}, {1})", "iszero": "({0} = 0)", "is_inf": "(abs({0}) = double('Infinity'))",
    "is_nan": "isnan({0})", "log": {1: "log10({0})", 2: "log({0}, {1})"}, "trunc": {1: "CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END", 2: "CASE WHEN {0} < 0 THEN ceil({0}, {1}) ELSE floor({0}, {1}) END"},
    "coth": "(cosh({0}) / sinh({0}))", "csch": "(1 / sinh({0}))", "sech": "(1 / cosh({0}))", "div": "({0} div {1})",
    "safe_add": "try_add({0}, {1})", "safe_subtract": "try_subtract({0}, {1})", "safe_multiply": "try_multiply({0}, {1})",
    "safe_divide": "try_divide({0}, {1})", "safe_negate": "try_subtract(0, {0})", "parse_numeric": "cast({0} AS decimal(38,9))",
    "parse_bignumeric": "cast({0} AS decimal(38,10))", "bit_count": "bit_count({0})",
    # regular expressions
    "regexp_like": {2: "({0} RLIKE {1})", 3: "({0} RLIKE concat('(?', {2}, ')', {1}))"},
    "regexp_count": {2: "regexp_count({0}, {1})", 3: "regexp_count(substr({0}, {2}), {1})", 4: "regexp_count(substr({0}, {2}), concat('(?', {3}, ')', {1}))"},
    "regexp_match": _regexp_match, "regexp_contains": "({0} RLIKE {1})",
    "regexp_replace": _regexp_replace,
    # text
    "concat": _concat, "ends_with": "endswith({0}, {1})", "starts_with": "startswith({0}, {1})", "strpos": "instr({0}, {1})",
    "substr_index": "substring_index({0}, {1}, {2})", "byte_length": "octet_length({0})", "edit_distance": "levenshtein({0}, {1})",
    "contains_substr": "contains(lower({0}), lower({1}))", "unicode": "ascii({0})", "format": "format_string({*})",
    "code_points_to_bytes": "unhex(array_join(transform({0}, z_e -> lpad(hex(z_e), 2, '0')), ''))",
    "code_points_to_string": "array_join(transform({0}, z_e -> decode(unhex(lpad(hex(z_e), 8, '0')), 'UTF-32')), '')", "chr": "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')",
    "to_code_points": "transform(filter(split({0}, ''), z_c -> z_c <> ''), z_c -> ascii(z_c))",
    "safe_convert_bytes_to_string": "try_validate_utf8(cast({0} AS string))",
    # arrays
    "array_to_string": "array_join({*})", "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'))",
    "range": {1: "if({0} > 0, sequence(0, {0} - 1), array())", 2: "if({0} < {1}, sequence({0}, greatest({0}, {1} - 1)), array())",
              3: f"filter({_STEPS}, z_e -> z_e <> {{1}})"},
    "gen_series": {2: _UP, 3: _STEPS}, "generate_series": {1: "if({0} >= 0, sequence(0, greatest(0, {0})), array())", 2: _UP, 3: _STEPS}, "generate_array": {2: _UP, 3: _STEPS},
    "array_ndims": "nullif(length(regexp_extract(typeof({0}), '^((array<)*)', 1)) div 6, 0)",
    "array_dims": "array(size({0}))", "array_concat": "concat({*})", "array_element": "try_element_at({0}, {1})",
    "array_pop_back": "slice({0}, 1, greatest(size({0}) - 1, 0))", "array_pop_front": "slice({0}, 2, size({0}))",
    "array_slice": "slice({0}, {1}, greatest({2} - {1} + 1, 0))", "array_any_value": "try_element_at(filter({0}, z_e -> z_e IS NOT NULL), 1)",
    "make_array": "array({*})", "array_has": "array_contains({0}, {1})", "array_has_all": "(size(array_except({1}, {0})) = 0)",
    "array_has_any": "arrays_overlap({0}, {1})", "array_empty": "(size({0}) = 0)", "array_length": "array_size({0})",
    "array_distance": _L2, "euclidean_distance": _L2, "cosine_distance": f"(1 - {_DOT} / ({_NORM % 0} * {_NORM % 1}))",
    "array_sort": "sort_array({*})", "array_resize": {2: "slice(concat({0}, array_repeat(NULL, {1})), 1, {1})", 3: "slice(concat({0}, array_repeat({2}, {1})), 1, {1})"},
    "array_reverse": "reverse({0})", "array_position": {2: "nullif(array_position({0}, {1}), 0)"},
    "array_positions": "filter(transform({0}, (z_e, z_i) -> if(z_e = {1}, z_i + 1, NULL)), z_p -> z_p IS NOT NULL)",
    "array_remove": "filter({0}, (z_e, z_i) -> z_i <> array_position({0}, {1}) - 1)", "array_remove_all": "array_remove({0}, {1})",
    "array_remove_n": "filter({0}, (z_e, z_i) -> NOT (z_e = {1} AND size(filter(slice({0}, 1, z_i + 1), z_z -> z_z = {1})) <= {2}))",
    "array_replace": "transform({0}, (z_e, z_i) -> if(z_i = array_position({0}, {1}) - 1, {2}, z_e))",
    "array_replace_all": "transform({0}, z_e -> if(z_e = {1}, {2}, z_e))",
    "array_replace_n": "transform({0}, (z_e, z_i) -> if(z_e = {1} AND size(filter(slice({0}, 1, z_i + 1), z_z -> z_z = {1})) <= {3}, {2}, z_e))",
    "array_first": "try_element_at({0}, 1)", "array_last": "try_element_at({0}, -1)", "map_extract": "array(try_element_at({0}, {1}))",
    "offset": "{0}[{1}]", "ordinal": "element_at({0}, {1})", "safe_offset": "get({0}, {1})", "safe_ordinal": "try_element_at({0}, {1})",
    "generate_range_array": "transform(filter(sequence({0}.start, {0}.end, {1}), z_e -> z_e < {0}.end), z_e -> struct(z_e AS start, least(z_e + {1}, {0}.end) AS end))",
    "range_contains": "({1} >= {0}.start AND {1} < {0}.end)", "range_start": "{0}.start", "range_end": "{0}.end",
    "range_intersect": "struct(greatest({0}.start, {1}.start) AS start, least({0}.end, {1}.end) AS end)",
    "range_overlaps": "({0}.start < {1}.end AND {1}.start < {0}.end)",
    # semi-structured
    "get_path": "variant_get(parse_json({0}), concat('$.', {1}), 'string')", "is_array": f"startswith(schema_of_variant({_V}), 'ARRAY')",
    "is_object": f"startswith(schema_of_variant({_V}), 'OBJECT')", "is_null_value": f"is_variant_null({_V})",
    "as_array": _PATH % "array<variant>", "as_object": _PATH % "map<string,variant>", "as_binary": _PATH % "binary", "as_boolean": _PATH % "boolean",
    "as_char": _PATH % "string", "as_varchar": _PATH % "string", "as_date": _PATH % "date", "as_decimal": _PATH % "decimal(38,10)",
    "as_number": _PATH % "decimal(38,10)", "as_double": _PATH % "double", "as_real": _PATH % "float", "as_integer": _PATH % "bigint",
    "as_timestamp": _PATH % "timestamp_ntz", "as_timestamp_tz": _PATH % "timestamp", "as_time": "try_to_time(" + _PATH % "string" + ")",
    "is_boolean": f"(schema_of_variant({_V}) = 'BOOLEAN')", "is_char": f"(schema_of_variant({_V}) = 'STRING')", "is_varchar": f"(schema_of_variant({_V}) = 'STRING')",
    "is_integer": f"(schema_of_variant({_V}) = 'BIGINT')", "is_double": f"(schema_of_variant({_V}) IN ('DOUBLE') OR schema_of_variant({_V}) LIKE 'DECIMAL%')",
    "is_real": f"(schema_of_variant({_V}) IN ('FLOAT', 'DOUBLE') OR schema_of_variant({_V}) LIKE 'DECIMAL%')", "is_binary": f"(schema_of_variant({_V}) = 'BINARY')",
    "is_date": f"(try_cast({_PATH % 'string'} AS date) IS NOT NULL)", "is_time": "(try_to_time(" + _PATH % "string" + ") IS NOT NULL)",
    "is_timestamp": f"(try_cast({_PATH % 'string'} AS timestamp_ntz) IS NOT NULL)", "is_timestamp_tz": f"(try_cast({_PATH % 'string'} AS timestamp) IS NOT NULL)",
    "bool": _PATH % "boolean", "int64": _PATH % "bigint", "float64": _PATH % "double", "lax_bool": _PATH % "boolean", "lax_int64": _PATH % "bigint",
    "lax_float64": _PATH % "double", "lax_string": _PATH % "string", "string": "cast({0} AS string)", "to_json_string": "regexp_replace(to_json(array({0})), '^\\\\[|\\\\]$', '')",
    "json_extract": "get_json_object({0}, {1})", "json_extract_scalar": "get_json_object({0}, {1})", "json_query": "get_json_object({0}, {1})",
    "json_value": "get_json_object({0}, {1})", "json_query_array": "from_json(get_json_object({0}, {1}), 'array<string>')",
    "json_value_array": "from_json(get_json_object({0}, {1}), 'array<string>')", "json_extract_array": {1: "from_json({0}, 'array<string>')", 2: "from_json(get_json_object({0}, {1}), 'array<string>')"},
    "json_extract_string_array": {1: "from_json({0}, 'array<string>')", 2: "from_json(get_json_object({0}, {1}), 'array<string>')"},
    "json_keys": "json_object_keys({0})", "json_array": "to_json(array({*}))", "json_object": "to_json(named_struct({*}))",
    "json_remove": "to_json(map_filter(from_json({0}, 'map<string,string>'), (z_k, z_v) -> concat('$.', z_k) <> {1}))",
    "json_set": "to_json(map_concat(map_filter(from_json({0}, 'map<string,string>'), (z_k, z_v) -> concat('$.', z_k) <> {1}), map(substring({1}, 3), cast({2} AS string))))",
    "json_strip_nulls": "to_json(map_filter(from_json({0}, 'map<string,string>'), (z_k, z_v) -> z_v IS NOT NULL))", "json_type": f"lower(schema_of_variant({_V}))",
    "json_array_append": "to_json(array_append(from_json({0}, 'array<string>'), cast({2} AS string)))",
    "json_array_insert": "to_json(array_insert(from_json({0}, 'array<string>'), cast(regexp_extract({1}, '([0-9]+)', 1) AS int) + 1, cast({2} AS string)))",
}

AGGREGATE: dict[str, str | Callable[[list[str]], str]] = {
    "approx_median": "approx_percentile({0}, 0.5D)", "approx_distinct": "approx_count_distinct({0})",
    "approx_percentile_cont": "approx_percentile({0}, {1})", "approx_percentile_cont_with_weight": "percentile({0}, {2}, {1})",
    "approx_quantiles": _quantiles, "approx_top_count": "approx_top_k({0}, {1})",
    "array_concat_agg": "flatten(collect_list({0}))", "countif": "count_if({0})", "logical_and": "bool_and({0})", "logical_or": "bool_or({0})",
    "group_concat": "listagg({*})", "stddev": "stddev_samp({0})",
}

_WINDOW = frozenset("row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value".split())

#: strftime letters in Spark's date patterns.
_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "f": "SSSSSS", "Z": "z", "z": "xx", "%": "%"}
#: Arrow type names where they differ from SQL's.
_ARROW = {"utf8": "string", "largeutf8": "string", "utf8view": "string", "float64": "double", "float32": "float", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "date32": "date", "boolean": "boolean", "binary": "binary"}


def _strftime(text: str) -> str:
    """A quoted strftime pattern as a quoted Spark pattern; literal letters are quoted."""
    if not (text.startswith("'") and text.endswith("'")):
        return text
    out, raw, k = [], text[1:-1], 0
    while k < len(raw):
        if raw[k] == "%" and k + 1 < len(raw):
            out.append(_LETTERS.get(raw[k + 1], raw[k + 1]))
            k += 2
        else:
            out.append(f"\\'{raw[k]}\\'" if raw[k].isalpha() else raw[k])
            k += 1
    return "'" + "".join(out) + "'"


def _operand(arg: str) -> str:
    """An argument as an operand: in parentheses unless it is one token or one call."""
    ts = [t for t in tokens(arg) if t.kind not in ("space", "comment")]
    if len(ts) < 2 or ts[0].text.lower() in ("distinct", "all"):
        return arg
    depth = 0
    for k, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and k and k < len(ts) - 1:
            return f"({arg})"
    return arg if ts[0].call or ts[0].text == "(" else f"({arg})"


def _fill(template: str, args: list[str]) -> str:
    args, listed, k = [_operand(a.strip()) for a in args], args, 0
    out: list[str] = []
    while k < len(template):
        if template[k] == "{":
            end = template.index("}", k)
            what, _, how = template[k + 1 : end].partition(":")
            if what == "*":
                out.append(", ".join(listed))
            else:
                a = args[int(what)] if not how else listed[int(what)].strip()
                if how == "strftime":
                    a = _strftime(a)
                elif how == "word":
                    a = a.strip("'\"").upper()
                elif how == "type":
                    a = _ARROW.get(a.strip("'").lower(), a.strip("'"))
                out.append(a)
            k = end + 1
        else:
            out.append(template[k])
            k += 1
    return "".join(out)


def _calls(ts: list[Token]) -> str:
    out, k, before = [], 0, ""
    while k < len(ts):
        t = ts[k]
        name = t.parts[-1].lower() if t.call else ""
        template = SCALAR.get(name) or AGGREGATE.get(name) if t.call and len(t.parts) == 1 else None
        if name == "extract":
            template = {}
        if t.text[0] in "`\"" or (name == "range" and before == "from"):
            template = None  # A quoted name is Spark's own function; after FROM range is a table.
        if t.kind not in ("space", "comment"):
            before = t.text.lower()
        if template is None:
            out.append(t.text)
            k += 1
            continue
        j = k + 1
        while ts[j].text != "(":
            j += 1
        depth, start, args = 0, j + 1, []
        while True:
            if ts[j].text in "([":
                depth += 1
            elif ts[j].text in ")]" and ts[j].kind == "other":
                depth -= 1
                if depth == 0:
                    break
            elif ts[j].text == "," and depth == 1:
                args.append(_calls(ts[start:j]).strip())
                start = j + 1
            j += 1
        last = _calls(ts[start:j]).strip()
        if last or args:
            args.append(last)
        if isinstance(template, dict):
            template = template.get(len(args))
        if name == "extract" and len(args) == 1 and (m := re.match(r"(?is)(?:dow|dayofweek)\s+from\s+(.*)", args[0])):
            out.append(_date_part(["dow", m[1]]))
        elif callable(template):
            out.append(template(args))
        elif template is None:
            out.append(f"{t.text}({', '.join(args)})")
        else:
            out.append(_fill(template, args))
        k = j + 1
    return "".join(out)


def translate(sql: str) -> str:
    """The statement or expression in Spark's syntax, with every call that has a template
    rewritten, inner calls first."""
    return _calls(tokens(to_spark(sql)))


@dataclass(frozen=True)
class RemoteFunction:
    """A user function's record: scalar, aggregate or window, with its types."""

    name: str
    kind: str = "scalar"
    return_type: str = "string"
    param_names: tuple[str, ...] = ()
    param_types: tuple[str, ...] = ()
    description: str = ""


def load_functions(rows: list[dict[str, str]]) -> list[RemoteFunction]:
    """Records from rows of a function list (function_type, name, return_type, ...)."""
    part = lambda x: tuple(p.strip() for p in (x or "").split(",") if p.strip())
    return [RemoteFunction(r["name"], r["function_type"], r.get("return_type") or "string", part(r.get("param_names")), part(r.get("param_types")), r.get("description") or "") for r in rows]


def approx_top_sum(df, value: str, weight: str, n: int, by: tuple[str, ...] = ()):
    """The n values of largest summed weight, one row each (for each group of ``by``); exact."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("sum"))
    order = Window.partitionBy(*by).orderBy(F.desc("sum"), value)
    if not by:
        return sums.orderBy(F.desc("sum"), value).limit(n)
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def available(spark: SparkSession) -> list[str]:
    """Every callable name: Spark's and the templates'."""
    own = {r[0].lower() for r in spark.sql("SHOW FUNCTIONS").collect()}
    return sorted(own | set(SCALAR) | set(AGGREGATE))


def _text(template) -> str:
    return template if isinstance(template, str) else (template.__doc__ or "") if callable(template) else str(template)


def define(spark: SparkSession, record: RemoteFunction, body) -> None:
    """Makes a user function callable in SQL.

    ``body`` is a SQL expression over the parameters, which Catalyst inlines (of kind "table": a query
    that gives rows), or a pandas function: of series to a series, or for kind "aggregate" of series
    to a value. Return types that follow the input (``same_as_input``) are inferred for SQL bodies.
    """
    from sparkloom.plans.exprs import quote

    if not re.fullmatch(r"[A-Za-z_]\w*", record.name):
        raise ValueError(f"not a function name: {record.name}")
    if len(record.param_names) != len(record.param_types) and isinstance(body, str):
        raise ValueError(f"{record.name}: a SQL function needs a type for each parameter")
    inferred = record.return_type.startswith(("same_as", "array_of"))
    if isinstance(body, str):
        params = ", ".join(f"{quote(n)} {_ARROW.get(t.lower(), t)}" for n, t in zip(record.param_names, record.param_types))
        kind = f"RETURNS TABLE ({record.return_type})" if record.kind == "table" else "" if inferred else f"RETURNS {record.return_type}"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {record.name}({params}) {kind} RETURN {translate(body)}")
        return
    from pyspark.sql import functions as F
    from pyspark.sql.functions import PandasUDFType

    if inferred or record.kind not in ("scalar", "aggregate"):
        raise ValueError(f"{record.name}: a Python body needs a fixed return type, and is scalar or aggregate")
    how = PandasUDFType.GROUPED_AGG if record.kind == "aggregate" else PandasUDFType.SCALAR
    spark.udf.register(record.name, F.pandas_udf(body, record.return_type, how))


def describe(spark: SparkSession, name: str) -> list[RemoteFunction]:
    """Records of a callable name: the dialect's template, else Spark's own; none if it is unknown."""
    low = name.lower()
    if low in SCALAR or low in AGGREGATE:
        return [RemoteFunction(low, "aggregate" if low in AGGREGATE else "scalar", "", description=_text(SCALAR.get(low) or AGGREGATE[low]))]
    if not spark.catalog.functionExists(low):
        return []
    text = "\n".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION EXTENDED `{low.replace('`', '``')}`").collect())
    kind = "aggregate" if ".aggregate." in text else "window" if low in _WINDOW else "scalar"
    return [RemoteFunction(low, kind, "", description=text.partition("Usage:")[2].strip())]


def install(spark: SparkSession) -> None:
    """Registers what Spark lacks, as Arrow-batched pandas functions; once a session."""
    if spark.catalog.functionExists("sparkloom_casefold"):
        return
    import base64
    import math
    import unicodedata

    from pyspark.sql import functions as F

    def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else math.gcd(int(x), int(y)) for x, y in zip(a, b)], dtype="Int64")

    def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else math.lcm(int(x), int(y)) for x, y in zip(a, b)], dtype="Int64")

    def two(fn, kind):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(x) or pd.isna(y) else fn(x, y) for x, y in zip(a, b)], dtype=object)

        return F.pandas_udf(run, kind)

    def one(fn, kind):
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or x is pd.NA else fn(x) for x in a], dtype=object)

        return F.pandas_udf(run, kind)

    spark.udf.register("sparkloom_gcd", F.pandas_udf(gcd, "bigint"))
    spark.udf.register("sparkloom_lcm", F.pandas_udf(lcm, "bigint"))
    spark.udf.register("sparkloom_from_base32", one(lambda x: base64.b32decode(x), "binary"))
    spark.udf.register("sparkloom_to_base32", one(lambda x: base64.b32encode(x if isinstance(x, bytes) else str(x).encode()).decode(), "string"))
    spark.udf.register("sparkloom_normalize", two(lambda x, f: unicodedata.normalize(f, x), "string"))
    spark.udf.register("sparkloom_casefold", two(lambda x, f: unicodedata.normalize(f, x.casefold()), "string"))
