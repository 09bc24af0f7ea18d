"""Text scalars as column expressions; Python only for what Spark lacks (NFC and fence state)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript has it, for a character class.  Fixed value.
WS = "\\s\u000b\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII word boundaries, the same in every engine.
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# The rules that find secrets, in the order in which they apply, with what replaces them.
SECRET_RULES = (
    ("bearer", rf"(?i){B0}(Bearer)[{WS}]+[A-Za-z0-9._~+/-]{{12,}}", "$1 [REDACTED]"),
    ("basic", rf"(?i){B0}(Basic)[{WS}]+[A-Za-z0-9+/=]{{12,}}", "$1 [REDACTED]"),
    ("jwt", rf"{B0}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{B1}", "[REDACTED_JWT]"),
    ("key", rf"{B0}(?:sk|pk|rk)-[A-Za-z0-9_-]{{16,}}{B1}", "[REDACTED_KEY]"),
    (
        "assignment",
        rf"(?i){B0}((?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|passwd|secret|auth[_-]?token)[{WS}]*[:=][{WS}]*)[\"']?[^{WS},\"'}}]{{8,}}[\"']?",
        "$1[REDACTED]",
    ),
    ("url", rf"(?i){B0}(https?://)([^{WS}/@:]+):([^{WS}/@]+)@", "$1[REDACTED]@"),
    ("database", rf"(?i){B0}(postgres(?:ql)?|mysql|mongodb)://([^{WS}/@:]+):([^{WS}/@]+)@", "$1://[REDACTED]@"),
)


def whole_json(x: Column | str) -> Column:
    """A JSON text as VARIANT; null where it is none from its first to its last character.

    Parsing alone takes what follows a first value for nothing, so the text is
    parsed as one element before a mark.
    """
    mark = "\\u0001"
    v = F.try_parse_json(F.concat(F.lit("["), F.col(x) if isinstance(x, str) else x, F.lit(f',"{mark}"]')))
    alone = (F.try_variant_get(v, "$[1]", "string") == "\u0001") & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(v, "$[0]", "variant"))


def trim_ws(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "")


def compact_lower(x: Column) -> Column:
    """White space runs as one space, trimmed, lower case."""
    return F.lower(trim_ws(F.regexp_replace(x, f"[{WS}]+", " ")))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, by which all limits count."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


#: Some part of this stands in every text that any rule finds something in.
SECRET_HINT = "(?i)bearer|basic|eyJ|[spr]k-|key|token|passw|secret|://"


def applied(name: str, rule: str, replacement: str, before: list[str]) -> Callable[[Column], Column]:
    """One rule as a step from state to state: the text after it, and its hits beside those of the rules before."""

    def step(s: Column) -> Column:
        return F.struct(F.regexp_replace(s["text"], rule, replacement).alias("text"), *(s[c].alias(c) for c in before), F.regexp_count(s["text"], F.lit(rule)).cast("long").alias(name))

    return step


def redaction(x: Column) -> Column:
    """A struct of the ``text`` without secrets and the hits of each rule, counted on what earlier rules left.

    Each rule's result is bound once (as the one element of an array) and handed
    to the next.  Texts without a hint of any rule are looked at once and left
    as they are.  Keep the struct as a column before taking its fields, so that
    it is computed once.
    """
    zero = F.lit(0).cast("long")
    state = F.array(F.struct(x.alias("text")))
    for k, (name, rule, replacement) in enumerate(SECRET_RULES):
        state = F.transform(state, applied(name, rule, replacement, [n for n, *_ in SECRET_RULES[:k]]))
    clean = F.struct(x.alias("text"), *(zero.alias(n) for n, *_ in SECRET_RULES))
    return F.when(x.rlike(SECRET_HINT), state[0]).when(x.isNotNull(), clean)


FENCE = re.compile(rf"[{WS}]*(```+|~~~+)")


def canonical(text: str) -> str:
    """LF line ends, NFC; outside fences no trailing tabs, at most two trailing spaces and two blank lines; no blank edges."""
    open_fence, blanks, kept = "", 0, []
    for line in unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n"):
        if not open_fence:
            line = line.rstrip("\t")
            bare = line.rstrip(" ")
            if len(line) - len(bare) > 2:
                line = bare + "  "
            blanks = blanks + 1 if not line else 0
            if blanks > 2:
                continue
        else:
            blanks = 0
        kept.append(line)
        if mark := FENCE.match(line):
            sign = mark[1][0]
            open_fence = sign if not open_fence else "" if open_fence == sign else open_fence
    return "\n".join(kept).strip("\n")


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """``canonical`` over a column; null stays null."""
    return texts.map(lambda t: None if t is None else canonical(t))


def fingerprint_text(canon: Column) -> Column:
    """Of canonical text: runs of tabs and spaces as one space, no blank lines, trimmed."""
    return trim_ws(F.regexp_replace(F.regexp_replace(canon, "[\\t ]+", " "), "\\n{2,}", "\n"))


def lexical_key(canon: Column) -> Column:
    """Of canonical text: lower case without punctuation, symbols and white space."""
    return F.regexp_replace(F.lower(canon), f"[\\p{{P}}\\p{{S}}{WS}]+", "")


def looks_like_code(x: Column) -> Column:
    """A fence begins some line."""
    return x.rlike(f"(^|\\n)[{WS}]*(```|~~~)")


def first_units(x: Column, n: Column) -> Column:
    """The first ``n`` UTF-16 units; a character that does not fit whole is left out."""
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.octet_length(F.encode(F.substring(x, i, F.lit(1)), "UTF-16BE")) / 2)
    fitting = F.aggregate(units, F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n")), lambda a, u: F.struct((a["used"] + u).alias("used"), F.when(a["used"] + u <= n, a["n"] + 1).otherwise(a["n"]).alias("n")))["n"]
    return F.when(F.length(x) == utf16_length(x), F.left(x, n)).otherwise(F.left(x, fitting))


def last_units(x: Column, n: Column) -> Column:
    """The last ``n`` UTF-16 units; a character that does not fit whole is left out."""
    return F.when(F.length(x) == utf16_length(x), F.right(x, n)).otherwise(F.reverse(first_units(F.reverse(x), n)))


#: What stands for the part of a text that is left out.  Fixed value.
OMITTED = ("\n...[", " chars omitted by result-first prefilter]...\n")


def bounded(x: Column, most: int) -> Column:
    """Head and tail of a long text with the number of UTF-16 units left out."""
    clean = trim_ws(x)
    head = max(400, int(most * 0.38))
    tail = max(400, most - head - 100)
    gone = (utf16_length(clean) - F.lit(head + tail)).cast("string")
    cut = F.concat(first_units(clean, F.lit(head)), F.lit(OMITTED[0]), gone, F.lit(OMITTED[1]), last_units(clean, F.lit(tail)))
    return F.when(utf16_length(clean) <= most, clean).otherwise(cut)


def pieces(x: Column, size: int) -> Column:
    """Fixed-width pieces of a text; one empty piece for an empty text."""
    last = F.greatest(F.lit(0), F.floor((F.length(x) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(x, i * size + 1, F.lit(size)))


def token_name(x: Column) -> Column:
    """Trimmed, lower case, all but a-z, 0-9 and _ as one _, none at the ends; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trim_ws(x)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(plain != "", plain)


def constraint_text(x: Column) -> Column:
    """Lower case without white space, brackets and CJK punctuation."""
    return F.regexp_replace(F.lower(trim_ws(x)), f"[{WS}，。；：、“”‘’（）()]+", "")


def iso_millis(x: Column) -> Column:
    """Milliseconds of an ISO date text; null for any other text."""
    iso = x.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:\\d{2})$")
    return F.when(iso, F.unix_millis(F.try_to_timestamp(x)))


def iso_text(ms: Column) -> Column:
    """ISO text of milliseconds; null for null and for times beyond the year 9999 or before 0."""
    inside = ms.between(-62167219200000, 253402300799999)
    return F.when(inside, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def stable_id(prefix: str, x: Column) -> Column:
    """``prefix`` and the first ten hex digits of the SHA-256 of the trimmed lower-case text."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.lower(trim_ws(x)), 256), F.lit(10)))


def round_half_up(x: Column) -> Column:
    """Rounding of halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))
