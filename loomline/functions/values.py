"""Loose JSON values made into plain ones.

Values come as JSON text (null: the value is missing).  What a value can't be
made into is null, and ``rejected`` tells it from a value that is rightly null;
so a batch with bad rows gives a table of violations instead of failing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loomline.functions.text import SECRET_RULES, WS, first_units, iso_millis, trim_ws, utf16_length, whole_json

TRIM = re.compile(rf"^[{WS}]+|[{WS}]+$")


def kind(value: Column) -> Column:
    """``null``, ``boolean``, ``number``, ``string``, ``array`` or ``object`` of a JSON text; null where it is missing or no JSON."""
    schema = F.schema_of_variant(whole_json(value))
    return (
        F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object").when(schema.isNotNull(), "number")
    )


def as_string(value: Column) -> Column:
    """The string of a JSON string; null for all else."""
    return F.when(kind(value) == "string", F.try_variant_get(whole_json(value), "$", "string"))


def as_number(value: Column) -> Column:
    """The number of a JSON number; null for all else."""
    return F.when(kind(value) == "number", F.try_variant_get(whole_json(value), "$", "double"))


# The words for yes and no.
YES, NO = ("true", "yes", "y", "1"), ("false", "no", "n", "0", "")


def loose_bool(value: Column) -> Column:
    """Booleans, 1 and other numbers, words for yes and no; missing and null are false; all else is rejected (null)."""
    word = F.lower(trim_ws(as_string(value)))
    return (
        F.when(value.isNull() | (kind(value) == "null"), False).when(kind(value) == "boolean", F.try_variant_get(whole_json(value), "$", "boolean"))
        .when(kind(value) == "number", as_number(value) == 1).when(word.isin(*YES), True).when(word.isin(*NO), False)
    )


#: The confidence of a value that gives none.  Fixed value.
DEFAULT_CONFIDENCE = 0.9


def confidence(value: Column) -> Column:
    """A number of 0 to 1: missing, null and blank count as ``DEFAULT_CONFIDENCE``, numbers in strings are brought into the range; other numbers beyond it and all else are rejected (null)."""
    word, number = trim_ws(as_string(value)), as_number(value)
    read = F.when(word.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), word.try_cast("double"))
    return (
        F.when(value.isNull() | (kind(value) == "null") | (word == ""), DEFAULT_CONFIDENCE).when(read.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), read)))
        .when(number.between(0, 1), number)
    )


def bounded_string(value: Column, most: int = 4_000, allow_empty: bool = False) -> Column:
    """A string trimmed; too long, empty (unless allowed) and what is no string is rejected (null)."""
    text = trim_ws(as_string(value))
    return F.when((utf16_length(text) <= most) & (F.lit(allow_empty) | (text != "")), text)


def error_text(x: Column) -> Column:
    """The first 500 UTF-16 units of an error."""
    return first_units(x, F.lit(500))


def any_millis(value: Column) -> Column:
    """Milliseconds of a JSON number, or of a string with an ISO date; null for all else."""
    return F.coalesce(F.floor(as_number(value)).cast("long"), iso_millis(as_string(value)))


def record_time(raw: Column) -> Column:
    """The time of a line (JSON text) as JSON text: its own ``timestamp``, else that of its message; strings and numbers count."""
    v = whole_json(raw)

    def at(path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        held = F.schema_of_variant(found)
        return F.when((held == "STRING") | held.startswith("DECIMAL") | held.isin("BIGINT", "DOUBLE"), F.to_json(found))

    return F.coalesce(at("$.timestamp"), at("$.message.timestamp"))


def plain(value: object) -> object:
    """Numbers that are whole as whole numbers, as JSON has but one kind."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, list):
        return [plain(x) for x in value]
    return {k: plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def written(value: object) -> str:
    """JSON text without spaces."""
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def over(function: Callable[[object], object], result):
    """A column function over parsed JSON texts: null for null and for what can't be parsed."""

    @F.pandas_udf(result)
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else function(json.loads(t)))
            except (ValueError, RecursionError):
                out.append(None)
        if isinstance(result, StructType):
            return pd.DataFrame([x or dict.fromkeys(result.names) for x in out], columns=result.names)
        return pd.Series(out, dtype=object)

    return run


def sorted_keys(value: object) -> object:
    """Objects with their keys in order of UTF-16 units, at every level."""
    if isinstance(value, dict):
        return {k: sorted_keys(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [sorted_keys(x) for x in value] if isinstance(value, list) else value


def units(text: str, most: int) -> str:
    """The first ``most`` UTF-16 units."""
    return text if len(text) <= most // 2 else text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def repaired(value: object) -> str:
    """Any value as text of at most 4,000 units: arrays joined by ``; ``, objects as JSON, null as nothing."""
    if isinstance(value, str):
        return units(TRIM.sub("", value), 4_000)
    if isinstance(value, list):
        parts = [TRIM.sub("", x) if isinstance(x, str) else written(x) for x in value]
        return units("; ".join(p for p in parts if p), 4_000)
    return "" if value is None else units(written(value), 4_000)


#: The fields of an object that describe it best, in this order.  Fixed value.
DESCRIBING = ("description", "statement", "summary", "name", "command", "effect", "detail", "task")


def loose_list(value: object, most: int = 2_000) -> list[str]:
    """Distinct texts: a string is cut at commas, semicolons and line ends, an object stands for the field that describes it."""
    if isinstance(value, str):
        items = [p for x in re.split(r"[,\n;]", value) if (p := TRIM.sub("", x))] or [value]
    else:
        items = value if isinstance(value, list) else [value]
    out: dict[str, None] = {}
    for x in items:
        if isinstance(x, dict):
            told = next((x[k] for k in DESCRIBING if x.get(k) is not None), None)
            text = TRIM.sub("", told) if isinstance(told, str) and TRIM.sub("", told) else written(x)
        else:
            text = TRIM.sub("", x) if isinstance(x, str) else "" if x is None else written(x)
        if text:
            out[units(text, most)] = None
    return list(out)


def occurrences(value: object) -> dict[str, int]:
    """How often each string stands as a value at any depth."""
    counts: dict[str, int] = {}
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            counts[x] = counts.get(x, 0) + 1
        elif isinstance(x, (list, dict)):
            stack += x if isinstance(x, list) else x.values()
    return counts


RULES = [(re.compile(rule.replace("(?i)", ""), re.I if rule.startswith("(?i)") else 0), replacement.replace("$1", r"\1")) for _, rule, replacement in SECRET_RULES]


def redacted(value: object) -> dict[str, object]:
    """``value`` as JSON with secrets replaced in every string that is a value, and the number of replacements."""
    count = 0

    def visit(x: object) -> object:
        nonlocal count
        if isinstance(x, str):
            for rule, replacement in RULES:
                x, n = rule.subn(replacement, x)
                count += n
            return x
        if isinstance(x, list):
            return [visit(y) for y in x]
        return {k: visit(y) for k, y in x.items()} if isinstance(x, dict) else x

    return {"value": written(visit(value)), "replaced": count}


#: JSON text with keys sorted at every level and no spaces.
canonical_json = over(lambda v: written(sorted_keys(v)), StringType())
#: ``repaired`` and ``loose_list`` of JSON texts; a missing value is an empty text and an empty list.
repair_text = over(repaired, StringType())
loose_strings = over(loose_list, ArrayType(StringType()))
#: ``redacted`` of JSON texts.
redact_json = over(redacted, StructType([StructField("value", StringType()), StructField("replaced", LongType())]))


def count_exact(target: str) -> Callable[[Column], Column]:
    """A column function: how often ``target`` stands as a string value in a JSON text."""
    return over(lambda v: occurrences(v).get(target, 0), LongType())


def worktree_state(value: Column) -> Column:
    """A string trimmed (empty is null, above 1,800 units rejected), arrays and objects as JSON cut to 1,800 units; all else is rejected (null)."""
    return F.when(kind(value) == "string", F.nullif(bounded_string(value, 1_800, allow_empty=True), F.lit(""))).when(kind(value).isin("array", "object"), over(lambda v: units(written(v), 1_800), StringType())(value))


def sorted_unique(values: Column) -> Column:
    """Distinct strings in order of code points."""
    return F.array_sort(F.array_distinct(values))
