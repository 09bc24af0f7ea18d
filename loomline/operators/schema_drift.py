"""Schemas that drift between the files of a stream.

Every task folds the records it reads into one small profile per file and field
(types, values, shapes).  Profiles of one file are merged, each file is compared
with the file before it, and the types of all files are folded through a
promotion lattice into one schema per record kind, to which every record is cast.

A profile keeps at most ``KEPT`` values and shapes of a field.  Where a file has
more and a rename depends on them, both files are read again and the sets are
compared whole, as rows (``exact_changes``).
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import Spool

#: Values and shapes kept in the profile of a field: those of least hash, so that merging never depends on order.
KEPT = 64
#: Fields without a common content that still pass as one under two names need a score of this.
SAME_CONTENT = 0.7
NAME_WEIGHT = 0.4
#: Parts of names that say nothing about the content.  Fixed values.
GENERIC = frozenset({"count", "num", "number", "id", "key", "at", "of", "the", "value", "is", "has", "text", "name"})

CHANGES = "file_name string, old_field string, new_field string, change_kind string"


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that holds both: boolean, number and string form a chain; an array promotes to a string with any other."""
    if a is None or a == b:
        return b
    if b is None:
        return a
    order = {"boolean": 0, "number": 1, "string": 2}
    if a in order and b in order:
        return a if order[a] > order[b] else b
    return "string"


def leaves(value: dict, path: str = "") -> Iterator[tuple[str, str, object]]:
    """(dotted path, type, value) of every value that is not null; ``[]`` marks arrays of objects."""
    for name, v in value.items():
        at = f"{path}{name}"
        if v is None:
            continue
        if isinstance(v, dict):
            yield from leaves(v, f"{at}.")
        elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
            for x in v:
                if isinstance(x, dict):
                    yield from leaves(x, f"{at}[].")
        elif isinstance(v, list):
            yield at, "array", v
        elif isinstance(v, bool):
            yield at, "boolean", v
        elif isinstance(v, (int, float)):
            yield at, "number", v
        else:
            yield at, "string", v


def readable(text: object) -> dict | None:
    """The record, or None where the line is no JSON object."""
    if not isinstance(text, str):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


TOKEN = re.compile(r"[0-9A-Za-z]+")
HEX = re.compile(r"[0-9a-f]{4,}$")


def shape(text: str) -> str:
    """The form of a string: runs of digits, hexadecimal digits and letters by kind, all signs as they are."""

    def kind(m: re.Match) -> str:
        t = m[0]
        return f"h{len(t)}" if HEX.match(t) else "9" if t.isdigit() else "a"

    return TOKEN.sub(kind, text)


def mark(text: str) -> int:
    """The hash that stands for a value."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 11


def trim(profile: dict, kept: int) -> None:
    """Back to the ``kept`` values, shapes and sizes of least hash; ``cut`` tells that some are missing."""
    for part in PARTS:
        if len(profile[part]) > kept:
            profile["cut"] = True
            profile[part] = set(sorted(profile[part], key=lambda x: (mark(x), x))[:kept])


#: The sets of a profile: values (of arrays all elements), their shapes, the sizes of arrays and their first elements.
PARTS = ("values", "shapes", "sizes", "heads")


def new_profile() -> dict:
    """An empty profile of one field."""
    return {"type": None, **{part: set() for part in PARTS}, "n": 0, "log": 0.0, "cut": False, "long": True}


def facts(kind: str, value: object) -> Iterator[tuple[str, str]]:
    """(part, text) of everything a profile keeps of one value."""
    if kind == "number":
        yield "values", repr(value)
    elif kind == "array":
        yield "sizes", str(len(value))
        for k, x in enumerate(value):
            text = x if isinstance(x, str) else json.dumps(x)
            yield "values", text
            if not k:
                yield "heads", text
            yield "shapes", shape(text)
    else:
        yield "values", str(value)
        if kind == "string":
            yield "shapes", shape(value)


def observe(profile: dict, kind: str, value: object, kept: int) -> None:
    """Fold one value into a profile."""
    profile["type"] = promote(profile["type"], kind)
    profile["n"] += 1
    if kind == "number":
        profile["log"] += math.log10(abs(value) + 1) if math.isfinite(value) else 0.0
        profile["long"] &= isinstance(value, int) and -(2**63) <= value < 2**63
    for part, text in facts(kind, value):
        profile[part].add(text if len(text) <= 80 else f"#{mark(text)}")
        if len(profile[part]) > 2 * kept:
            trim(profile, kept)


def merge(a: dict, b: dict, kept: int) -> dict:
    """Two profiles of one field."""
    out = {"type": promote(a["type"], b["type"]), "n": a["n"] + b["n"], "log": a["log"] + b["log"], "cut": a["cut"] or b["cut"], "long": a["long"] and b["long"]}
    out |= {part: a[part] | b[part] for part in PARTS}
    trim(out, kept)
    return out


def telling(shape: str) -> bool:
    """Whether a shape is more than one word or number."""
    return shape not in ("a", "9", "")


#: (part) -> in how many values, telling shapes or sizes two fields agree, and how many each has.
Measure = Callable[[str], tuple[int, int, int]]


def measured(a: dict, b: dict) -> Measure:
    """The measure of two whole profiles."""

    def measure(part: str) -> tuple[int, int, int]:
        x, y = ({k for k in p[part] if part != "shapes" or telling(k)} for p in (a, b))
        return len(x & y), len(x), len(y)

    return measure


def overlap(shared: int, x: int, y: int) -> float:
    """The part of the smaller set found in the other."""
    return shared / min(x, y) if x and y else 0.0


def alike(shared: int, x: int, y: int) -> float:
    """The part of all values that both sets hold."""
    return shared / max(1, x + y - shared)


def content_score(a: dict, b: dict, measure: Measure) -> float:
    """How far two fields hold the same content.

    The scale is such that, with the weight of names, the same content needs no
    name in common (0.7 and more), content alike needs half a name (0.5), content
    that neither speaks for nor against a whole one (0.35 and more), and another
    type is no same content whatever the name.
    """
    if a["type"] != b["type"]:
        return 0.0
    if a["type"] == "boolean":
        return 0.4
    if a["type"] == "number":
        if measure("values") == (1, 1, 1):
            return 0.8
        x, y = a["log"] / a["n"], b["log"] / b["n"]
        if min(x, y) > 6 and abs(x - y) < 0.02:
            return 0.85
        return 0.5 if abs(x - y) < 0.5 else 0.35
    if a["type"] == "array" and not overlap(*measure("sizes")):
        return 0.2
    if overlap(*measure("shapes")) >= 0.5:
        return 0.85
    if alike(*measure("values")) >= 0.34 or alike(*measure("heads")) >= 0.5:
        return 0.9
    return 0.35


def name_tokens(name: str) -> list[str]:
    """The parts of a name in lower case, plural endings and generic parts left out."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    kept = [p[:-1] if len(p) > 3 and p.endswith("s") else p for p in parts if p not in GENERIC]
    return kept or parts


def name_score(a: str, b: str) -> float:
    """The part of the shorter name's parts that begin a part of the other name, or the reverse."""
    x, y = sorted((name_tokens(a), name_tokens(b)), key=len)
    hit = sum(any(p.startswith(q) or q.startswith(p) for q in y if min(len(p), len(q)) > 1) for p in x)
    return hit / len(x) if x else 0.0


def split_name(path: str) -> tuple[str, str]:
    """(object, name) of a path."""
    at = path.rfind(".")
    return path[: at + 1], path[at + 1 :]


def open_pairs(old: dict, new: dict) -> list[tuple[str, str]]:
    """(old field, new field) that may be one field under two names: gone and come, in the same object."""
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    return [(f, g) for f in gone for g in come if split_name(f)[0] == split_name(g)[0]]


def undecided(old: dict, new: dict) -> bool:
    """Whether a rename depends on sets that a profile does not hold whole."""
    return any(old[f]["type"] == new[g]["type"] and (old[f]["cut"] or new[g]["cut"]) for f, g in open_pairs(old, new))


def compare(old: dict, new: dict, measure: Callable[[str, str], Measure] | None = None) -> list[tuple[str, str, str]]:
    """(old field, new field, kind) of every change between two files' fields."""
    changes = [(f, f, "retyped") for f in sorted(old.keys() & new.keys()) if old[f]["type"] != new[f]["type"]]
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    scored = []
    for f, g in open_pairs(old, new):
        content = content_score(old[f], new[g], measure(f, g) if measure else measured(old[f], new[g]))
        total = content + NAME_WEIGHT * name_score(split_name(f)[1], split_name(g)[1])
        if total >= SAME_CONTENT:
            scored.append((-total, f, g))
    for _, f, g in sorted(scored):
        if f in gone and g in come:
            gone.remove(f)
            come.remove(g)
            changes.append((f, g, "renamed"))
    return changes + [("", g, "added") for g in come] + [(f, "", "removed") for f in gone]


def packed(fields: dict) -> bytes:
    """The profiles of a file in few bytes."""
    return zlib.compress(json.dumps({path: p | {part: sorted(p[part]) for part in PARTS} for path, p in sorted(fields.items())}).encode(), 1)


def unpacked(data: bytes) -> dict:
    """The reverse of ``packed``."""
    return {path: p | {part: set(p[part]) for part in PARTS} for path, p in json.loads(zlib.decompress(bytes(data))).items()}


KEY = ["stream_id", "file_seq", "file_name"]


def keyed(records: DataFrame) -> DataFrame:
    """The columns that profiles need, of rows that belong to a file."""
    return records.filter("file_name is not null").select("stream_id", F.col("file_seq").cast("long").alias("file_seq"), "file_name", "record_kind", "raw_text")


def file_profiles(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """``stream_id``, ``file_seq``, ``file_name``, ``record_kind``, ``profile`` (packed): one row per file with a readable record.

    A file is named by stream, sequence and name together, its kind is the
    greatest of its records.  Partial profiles are made where the records are
    read; only they are moved.
    """
    schema = "stream_id string, file_seq long, file_name string, record_kind string, profile binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files: dict = {}
            for key in zip(b["stream_id"], b["file_seq"], b["file_name"], b["record_kind"], b["raw_text"], strict=True):
                found = readable(key[4])
                if found is None:
                    continue
                fields = files.setdefault(tuple(None if v is None or v != v else v for v in key[:4]), {})
                for path, kind, value in leaves(found):
                    observe(fields.setdefault(path, new_profile()), kind, value, kept)
            yield frame(files)

    def frame(files: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*k, packed(v)) for k, v in files.items()], columns=[*KEY, "record_kind", "profile"])
        return out.astype({"file_seq": "Int64"})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kind, fields = None, None, {}
        for b in batches:
            done: dict = {}
            for *k, told, text in zip(*(b[c] for c in KEY), b["record_kind"], b["profile"], strict=True):
                k = tuple(None if v is None or v != v else v for v in k)
                if k != key:
                    if key is not None:
                        done[(*key, kind)] = close(fields)
                    key, fields = k, {}
                kind = told
                for path, p in unpacked(text).items():
                    fields[path] = merge(fields[path], p, kept) if path in fields else p
            yield frame(done)
        if key is not None:
            yield frame({(*key, kind): close(fields)})

    def close(fields: dict) -> dict:
        # An array that holds objects in some record is described by their fields alone.
        holders = {p.split("[]")[0] for p in fields if "[]" in p}
        return {p: v for p, v in fields.items() if not (p in holders and v["type"] == "array")}

    parts = keyed(records).mapInPandas(partial, schema)
    return parts.repartition(*(F.col(c) for c in KEY)).sortWithinPartitions(*KEY, "record_kind").mapInPandas(whole, schema)


def same_file(prefix: str) -> Column:
    """The join condition of two file keys, the right one with this prefix."""
    return F.col("stream_id").eqNullSafe(F.col(f"{prefix}stream_id")) & F.col("file_seq").eqNullSafe(F.col(f"{prefix}file_seq")) & (F.col("file_name") == F.col(f"{prefix}file_name"))


LOG = "stream_id string, file_seq long, file_name string, change_no long, old_field string, new_field string, change_kind string"


def changes(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """The ordered log of changes (``LOG``): every change of a file against the file before it in its stream.

    records: ``stream_id``, ``file_seq``, ``file_name``, ``record_kind``,
    ``raw_text``.  ``change_no`` counts the changes of a file from 1: retyped,
    renamed (surest first), added, removed.  Lines that are null, empty or no
    JSON object count for nothing; a file without a readable line is no file;
    repeated lines change nothing.  Rows without ``file_name`` are left out; a
    null ``stream_id`` is a stream of its own; a null ``file_seq`` comes first,
    equal ones go by name; a name in several streams is a file in each.  The
    order of files is found on their keys alone, so that no task sorts the
    profiles of a whole stream.
    """
    profiles = Spool(file_profiles(records, kept), "profiles").df.drop("record_kind")
    order = Window.partitionBy("stream_id").orderBy(F.col("file_seq").asc_nulls_first(), "file_name")
    before = F.lag(F.struct(*KEY)).over(order).alias("before")
    steps = profiles.select(*KEY, before).filter("before is not null").select(*KEY, *(F.col(f"before.{c}").alias(f"old_{c}") for c in KEY))
    old = profiles.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("profile").alias("old"))
    new = profiles.select(*(F.col(c).alias(f"_new_{c}") for c in KEY), F.col("profile").alias("new"))
    at_old = F.col("old_stream_id").eqNullSafe(F.col("_stream_id")) & F.col("old_file_seq").eqNullSafe(F.col("_file_seq")) & (F.col("old_file_name") == F.col("_file_name"))
    both = steps.join(old, at_old).join(new, same_file("_new_")).select(*KEY, "old_file_seq", "old_file_name", "old", "new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, x, y in zip(*(b[c] for c in KEY), b["old"], b["new"], strict=True):
                if x == y:
                    continue
                a, c = unpacked(x), unpacked(y)
                found = [("", "", "undecided")] if undecided(a, c) else compare(a, c)
                rows += [(*key, n + 1, *change) for n, change in enumerate(found)]
            yield log_frame(rows)

    logged = Spool(both.select(*KEY, "old", "new").mapInPandas(run, LOG), "changes").df
    left = logged.filter("change_kind = 'undecided'").select(*(F.col(c).alias(f"_left_{c}") for c in KEY))
    if not left.limit(1).count():
        return logged
    open_files = Spool(both.join(left, same_file("_left_"), "left_semi").withColumn("pair", F.xxhash64(*KEY)), "undecided").df
    return logged.filter("change_kind <> 'undecided'").unionByName(exact_changes(records, open_files))


def log_frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of the log as a frame."""
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")], dtype=object)
    return out.astype({"file_seq": "Int64", "change_no": "int64"})


def exact_changes(records: DataFrame, open_files: DataFrame) -> DataFrame:
    """The changes of files (``pair``, keys, ``old``, ``new``) whose sets are larger than a profile: each value is a row, shared ones are counted by a join."""
    sides = [
        open_files.select("pair", F.lit(side).alias("side"), F.col("stream_id").alias("_stream_id"), F.col(f"{name}file_seq").alias("_file_seq"), F.col(f"{name}file_name").alias("_file_name"), "old", "new")
        for side, name in (("old", "old_"), ("new", ""))
    ]
    asked = keyed(records).join(sides[0].unionByName(sides[1]), same_file("_")).select("pair", "side", "raw_text", "old", "new")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict = {}
        for b in batches:
            rows = set()
            for pair, side, text, x, y in zip(b["pair"], b["side"], b["raw_text"], b["old"], b["new"], strict=True):
                if (found := readable(text)) is None:
                    continue
                if (pair, side) not in wanted:
                    wanted[pair, side] = {p[side == "new"] for p in open_pairs(unpacked(x), unpacked(y))}
                for path, kind, value in leaves(found):
                    if path in wanted[pair, side]:
                        rows.update((pair, side, path, part, mark(t)) for part, t in facts(kind, value) if part != "shapes" or telling(t))
            yield pd.DataFrame(list(rows), columns=["pair", "side", "field", "part", "mark"])

    marks = Spool(asked.mapInPandas(spread, "pair long, side string, field string, part string, mark long").distinct(), "marks").df
    sizes = marks.groupBy("pair", "side", "field", "part").agg(F.count("*").alias("n"))
    other = marks.filter("side = 'new'").select("pair", "part", "mark", F.col("field").alias("other"))
    shared = marks.filter("side = 'old'").join(other, ["pair", "part", "mark"]).groupBy("pair", "field", "other", "part").agg(F.count("*").alias("n"))
    rows = sizes.select("pair", F.struct("side", "field", F.lit("").alias("other"), "part", "n").alias("r")).unionByName(shared.select("pair", F.struct(F.lit("both").alias("side"), "field", "other", "part", "n").alias("r")))
    gathered = rows.groupBy("pair").agg(F.collect_list("r").alias("rows"))  # at most a few per field of two files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, x, y, rows in zip(*(b[c] for c in KEY), b["old"], b["new"], b["rows"], strict=True):
                n = {(r["side"], r["field"], r["other"], r["part"]): r["n"] for r in rows}

                def measure(f: str, g: str, n: dict = n) -> Measure:
                    return lambda part: (n.get(("both", f, g, part), 0), n.get(("old", f, "", part), 0), n.get(("new", g, "", part), 0))

                out += [(*key, k + 1, *change) for k, change in enumerate(compare(unpacked(x), unpacked(y), measure))]
            yield log_frame(out)

    return open_files.join(gathered, "pair").select(*KEY, "old", "new", "rows").mapInPandas(run, LOG)


def drift(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """The distinct changes of ``changes`` by file name (``CHANGES``)."""
    return changes(records, kept).select("file_name", "old_field", "new_field", "change_kind").distinct()


def fields(records: DataFrame) -> DataFrame:
    """The union schema: ``record_kind``, ``field``, promoted ``type``, number of ``files`` and of types met.

    The lattice: boolean, long, double, string in this order; an array goes to
    string with any other.  Numbers are long where all of them are whole and fit.
    """
    lattice = F.when(F.array_contains("met", "string") | (F.array_contains("met", "array") & (F.size("met") > 1)), "string").otherwise(
        F.when(F.array_contains("met", "array"), "array").otherwise(F.when(F.array_contains("met", "number"), F.when(F.col("long"), "long").otherwise("double")).otherwise("boolean"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f, p["type"], p["long"]) for k, text in zip(b["record_kind"], b["profile"], strict=True) for f, p in unpacked(text).items()]
            yield pd.DataFrame(rows, columns=["record_kind", "field", "type", "long"], dtype=object)

    each = file_profiles(records).mapInPandas(run, "record_kind string, field string, type string, long boolean")
    counted = each.groupBy("record_kind", "field").agg(F.count("*").alias("files"), F.collect_set("type").alias("met"), F.min("long").alias("long"))
    return counted.select("record_kind", "field", lattice.alias("type"), "files", F.size("met").cast("long").alias("types"))


def unified(records: DataFrame, kind: str) -> DataFrame:
    """All readable records of one kind as one table with the union schema.

    Columns: ``record_id``, ``file_name``, then one per field, in order of name,
    as boolean, long, double or string by its promoted type (arrays and values of
    objects in arrays as JSON text).  A value that a record lacks is null.
    """
    mine = records.filter(F.col("record_kind") == kind)
    wanted = [(r["field"], r["type"]) for r in fields(mine).orderBy("field").collect()]
    spark_type = {"boolean": "boolean", "long": "long", "double": "double", "string": "string", "array": "string"}

    def cast(kind: str, values: list) -> object:
        if not values:
            return None
        if len(values) > 1 or kind == "array" or isinstance(values[0], list):
            return json.dumps(values if len(values) > 1 else values[0], ensure_ascii=False)
        v = values[0]
        if kind in ("long", "double"):
            return int(v) if kind == "long" else float(v)
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v)
        return v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, name, text in zip(b["record_id"], b["file_name"], b["raw_text"], strict=True):
                found = readable(text)
                if found is None:
                    continue
                held: dict = {}
                for path, _, value in leaves(found):
                    held.setdefault(path, []).append(value)
                rows.append((rid, name, *(cast("string" if "[]" in f else t, held.get(f, [])) for f, t in wanted)))
            yield pd.DataFrame(rows, columns=["record_id", "file_name", *(f for f, _ in wanted)], dtype=object)

    listed = [(f, "string" if "[]" in f else t) for f, t in wanted]
    schema = ", ".join(["record_id long", "file_name string", *(f"`{f}` {spark_type[t]}" for f, t in listed)])
    return mine.select("record_id", "file_name", "raw_text").mapInPandas(run, schema)
