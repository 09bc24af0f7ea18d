"""Model responses that state facts, summaries and reviews: made uniform, and checked row by row."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import WS, first_units, trim_ws, utf16_length
from loomline.functions.values import sorted_unique

# The words accepted for each category, status and confidence, and what all other words mean.
CATEGORIES = {
    "state": "state current_state", "capability": "capability feature ability", "entry_point": "entry_point entrypoint entry", "decision": "decision choice",
    "invariant": "invariant constant", "failure": "failure error bug", "fix": "fix patch repair", "verification": "verification verify test",
    "constraint": "constraint limit limitation", "open_work": "open_work openwork open todo",
}
STATUSES = {"current": "current active now present", "historical": "historical past old done", "superseded": "superseded supersede replaced stale", "unresolved": "unresolved"}
CONFIDENCES = {"verified": "verified high certain confirmed definite known", "inferred": "inferred"}
OTHERWISE = {"category": "state", "status": "unresolved", "confidence": "inferred"}
#: Ids, subjects and domains of facts.
SLUG = r"^[A-Za-z0-9][A-Za-z0-9._:#\- ]{0,199}$"
#: The sections of a summary, in order.  Fixed values.
HEADINGS = ("## Current State", "## System Map", "## Decisions and Invariants", "## Lessons from Failures", "## Open Work", "## How to Resume", "## Evidence Boundaries")
#: What a summary must not mention.  Fixed values.
PROVENANCE = r"(?i)(?:session-distill-backups|cleanup_manifest|coveredSourceIds|fact-ledger|##\s+Source Coverage|\.pi/agent/sessions/)"
#: What a review scores, each from 1 to 5; 4 passes.  Fixed values.
CRITERIA = ("scopePurity", "currentState", "contradictionResolution", "actionability", "concision", "sourceFaithfulness")
PASSES = 4
#: Categories of facts that a review must cite whatever their status.  Fixed values.
REQUIRED = ("decision", "invariant", "entry_point", "constraint", "open_work")


def uniform(word: Column, words: dict[str, str], otherwise: str) -> Column:
    """The canonical value of a word (case, and runs of spaces, hyphens and underscores alike)."""
    token = F.regexp_replace(F.lower(trim_ws(word)), f"[_\\-{WS}]+", "_")
    out = F.lit(otherwise)
    for value, accepted in words.items():
        out = F.when(token.isin(*accepted.split()), value).otherwise(out)
    return out


def uniform_facts(facts: DataFrame) -> DataFrame:
    """Facts with canonical ``category``, ``status`` and ``confidence``, and ``statement`` trimmed; unknown and missing words get what ``OTHERWISE`` says."""
    tables = {"category": CATEGORIES, "status": STATUSES, "confidence": CONFIDENCES}
    return facts.withColumns({c: uniform(F.coalesce(c, F.lit("")), t, OTHERWISE[c]) for c, t in tables.items()} | {"statement": trim_ws(F.col("statement"))})


def resolved_sources(refs: DataFrame, expected: DataFrame) -> DataFrame:
    """References (``ledger_id``, ``fact_id``, ``ref``) with the expected source (``ledger_id``, ``source_id``) they mean as ``source_id``.

    By the id itself, else whatever its case, else as part of the id or the
    reverse (the least such id); what means none stays as it is.  Only
    references without an equal id are compared by parts, within their ledger.
    """
    ids = expected.select("ledger_id", "source_id", F.lower("source_id").alias("_low")).distinct()
    rows = refs.filter("ref <> ''").distinct().withColumn("_ref", F.lower("ref"))
    equal = ids.groupBy("ledger_id", "_low").agg(F.min("source_id").alias("_any"), F.collect_set("source_id").alias("_ids"))
    first = rows.join(equal, (rows.ledger_id == equal.ledger_id) & (rows._ref == equal._low), "left").select(rows.ledger_id, "fact_id", "ref", "_ref", F.when(F.array_contains("_ids", F.col("ref")), F.col("ref")).otherwise(F.col("_any")).alias("_found"))
    rest = first.filter("_found is null").join(ids, "ledger_id").filter(F.contains("_low", "_ref") | F.contains("_ref", "_low")).groupBy("ledger_id", "fact_id", "ref").agg(F.min("source_id").alias("_part"))
    return first.join(rest, ["ledger_id", "fact_id", "ref"], "left").select("ledger_id", "fact_id", "ref", F.coalesce("_found", "_part", "ref").alias("source_id"))


def fact_faults(facts: DataFrame) -> DataFrame:
    """``ledger_id``, ``fact_id``, ``fault``: facts whose id, subject, domain, statement or date is not as it must be (the first fault of each)."""
    slug = lambda c: F.coalesce(F.col(c).rlike(SLUG), F.lit(False))
    line = lambda c, most: F.coalesce((trim_ws(F.col(c)) != "") & (utf16_length(F.col(c)) <= most) & ~F.col(c).rlike("[\r\n]"), F.lit(False))
    fault = (
        F.when(~slug("fact_id"), "id").when(~slug("subject"), "subject").when(~slug("domain"), "domain").when(~line("statement", 800), "statement").when(~line("as_of", 100), "date")
    )
    return facts.select("ledger_id", "fact_id", fault.alias("fault")).filter("fault is not null")


def domain_faults(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """``ledger_id``, ``domain``, ``fault``: domains declared but not used, or used but not declared."""
    used, said = facts.select("ledger_id", "domain").distinct(), declared.select("ledger_id", "domain").distinct()
    return said.join(used, ["ledger_id", "domain"], "left_anti").withColumn("fault", F.lit("unused")).unionByName(used.join(said, ["ledger_id", "domain"], "left_anti").withColumn("fault", F.lit("undeclared")))


def joined_domain(facts: DataFrame, most: int = 100) -> DataFrame:
    """``ledger_id``, ``domain``: the distinct domains of each ledger joined by ``+``; null beyond ``most`` characters.  A ledger has few domains."""
    name = F.array_join(sorted_unique(F.collect_set("domain")), "+")
    return facts.groupBy("ledger_id").agg(name.alias("domain")).select("ledger_id", F.when(utf16_length(F.col("domain")) <= most, F.col("domain")).alias("domain"))


def required_facts(facts: DataFrame) -> DataFrame:
    """The facts that a review must cite."""
    return facts.filter(F.col("status").isin("current", "unresolved") | F.col("category").isin(*REQUIRED))


def section_bodies(markdown: Column) -> Column:
    """The trimmed bodies of the second-level sections of a text, in order."""
    lines = F.split(F.concat(F.lit("\n"), markdown), f"\n[{WS}&&[^\n]]*##[{WS}&&[^\n]][^\n]*", -1)
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), trim_ws)


def capsule_fault(title: Column, domain: Column, markdown: Column, sources: Column, expected: str | None = None) -> Column:
    """The first thing wrong with a summary, null if nothing is: title, domain, size, headings (all, once, in order), an empty section, provenance in the text, a repeated paragraph, an open fence."""
    heads = F.filter(F.transform(F.split(markdown, "\n"), trim_ws), lambda x: x.rlike(f"^##[{WS}]"))
    wanted = F.array(*(F.lit(h) for h in HEADINGS))
    long_ones = F.filter(F.transform(F.split(markdown, f"\n[{WS}]*\n"), lambda p: F.regexp_replace(trim_ws(p), f"[{WS}]+", " ")), lambda p: (utf16_length(p) >= 80) & ~p.rlike(f"^#{{1,6}}[{WS}]"))
    name = trim_ws(domain)
    known = F.lit(True) if expected is None else name == expected
    checks = (
        ("title", (trim_ws(title) != "") & (utf16_length(title) <= 200)), ("domain", (name != "") & (utf16_length(domain) <= 100) & (F.upper(name) != "AMBIGUOUS") & known),
        ("size", (trim_ws(markdown) != "") & (utf16_length(markdown) <= 12_000)), ("headings", heads == wanted), ("empty section", ~F.exists(section_bodies(markdown), lambda b: b == "")),
        ("provenance", ~markdown.rlike(PROVENANCE) & ~F.exists(sources, lambda s: F.contains(markdown, s))), ("repeated paragraph", F.size(long_ones) == F.size(F.array_distinct(long_ones))),
        ("open fence", F.regexp_count(markdown, F.lit("```")) % 2 == 0),
    )
    out = F.lit(None).cast("string")
    for fault, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), fault).otherwise(out)
    return out


#: The title of a summary that has none.  Fixed value.
UNTITLED = "清洗后的会话摘要"


def lenient_capsule(title: Column, domain: Column, markdown: Column, sources: Column) -> Column:
    """A summary made to fit (``title``, ``domain``, ``markdown``): cut to size, missing names replaced; null without any text."""
    name, area = trim_ws(F.coalesce(title, F.lit(""))), trim_ws(F.coalesce(domain, F.lit("")))
    area = F.when((area == "") | (F.upper(area) == "AMBIGUOUS"), F.coalesce(F.get(sources, F.lit(0)), F.lit("session"))).otherwise(area)
    text = trim_ws(markdown)
    made = F.struct(first_units(F.when(name == "", UNTITLED).otherwise(name), F.lit(200)).alias("title"), first_units(area, F.lit(100)).alias("domain"), first_units(text, F.lit(12_000)).alias("markdown"))
    return F.when(F.coalesce(text, F.lit("")) != "", made)


def review_fault(review: Column, facts: Column, required: Column) -> Column:
    """The first thing wrong with a review (JSON text), null if nothing is.

    ``facts`` and ``required`` are arrays of fact ids.  Checked are: six whole
    scores of 1 to 5, one piece of evidence per criterion that names a section
    and known facts, all required facts cited, ``pass`` true exactly if all
    scores pass, and issues and instructions exactly if it does not.
    """
    shape = f"pass boolean, scores struct<{','.join(f'{c}:double' for c in CRITERIA)}>, evidence array<struct<criterion:string,section:string,factIds:array<string>>>, issues array<string>, rewriteInstructions string"
    r = F.from_json(review, shape)
    scores = [r["scores"][c] for c in CRITERIA]
    every = lambda test: reduce(and_, map(test, scores))
    told = trim_ws(r["rewriteInstructions"])
    section = lambda e: F.when(trim_ws(e["section"]).startswith("## "), trim_ws(e["section"])).otherwise(F.concat(F.lit("## "), trim_ws(e["section"])))
    cited = F.flatten(F.transform(r["evidence"], lambda e: e["factIds"]))
    sound = lambda e: e["criterion"].isin(*CRITERIA) & section(e).isin(*HEADINGS) & (F.size(e["factIds"]) > 0) & F.forall(e["factIds"], lambda f: F.array_contains(facts, f))
    checks = (
        ("pass", r["pass"].isNotNull()), ("scores", every(lambda s: s.between(1, 5) & (s == F.floor(s)))),
        ("evidence", (F.size(r["evidence"]) == len(CRITERIA)) & (F.size(F.array_distinct(F.transform(r["evidence"], lambda e: e["criterion"]))) == len(CRITERIA)) & F.forall(r["evidence"], lambda e: F.coalesce(sound(e), F.lit(False)))),
        ("required facts", F.size(F.array_except(required, cited)) == 0), ("issues", r["issues"].isNotNull() & F.forall(r["issues"], lambda i: F.coalesce(trim_ws(i) != "", F.lit(False))) & told.isNotNull()),
        ("pass and scores", r["pass"] == every(lambda s: s >= PASSES)), ("issues and pass", F.when(r["pass"], (F.size(r["issues"]) == 0) & (told == "")).otherwise((F.size(r["issues"]) > 0) & (told != ""))),
    )
    out = F.lit(None).cast("string")
    for fault, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), fault).otherwise(out)
    return out


def reduction_groups(chunked: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``reduce_group`` to packed blocks (``chunk``): their chunk, or pairs in order where nothing was combined in a ``group`` of several blocks.

    Where each block is a chunk of its own, the chunk is the block's number, so
    pairs need no ranking.
    """
    sizes = chunked.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.count_distinct("chunk").alias("_c"))
    pair = F.floor((F.col("chunk") - 1) / 2).cast("long") + 1
    return chunked.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("reduce_group", F.when((F.col("_n") > 1) & (F.col("_n") == F.col("_c")), pair).otherwise(F.col("chunk"))).drop("_g", "_n", "_c")


def chunk_evidence(chunked: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per packed chunk (``source_id``, ``chunk``): ``coverage_id``, ``locator``, ``content``, ``content_hash``, ``evidence_id``.

    A chunk's blocks are bounded by the packing limit; they are joined by blank lines.
    """
    sizes = chunked.groupBy(F.col("source_id").alias("_s")).agg(F.max("chunk").alias("_of"))
    held = chunked.groupBy("source_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"]), "\n\n").alias("content"))
    rows = held.join(sizes, F.col("source_id").eqNullSafe(F.col("_s"))).withColumn("content_hash", F.sha2("content", 256))
    source = F.coalesce("source_id", F.lit(""))
    place = lambda name: F.concat(source, F.lit(f"#{name}-"), F.col("chunk").cast("string"), F.lit("-of-"), F.col("_of").cast("string"))
    made = rows.withColumn("coverage_id", place("handoff-chunk")).withColumn("locator", place("active-branch-chunk"))
    ident = F.concat(F.lit("EVD-"), F.left(F.sha2(F.lower(trim_ws(F.concat_ws("\n", source, "coverage_id", "content_hash"))), 256), F.lit(10)))
    return made.select("source_id", "chunk", "coverage_id", "locator", "content", "content_hash", ident.alias("evidence_id"))


def flags_once(flags: DataFrame) -> DataFrame:
    """Flags (``ref``, ``summary``, ``position``, ``value``) once per reference and summary: at their first position, with their last value."""
    return flags.groupBy("ref", "summary").agg(F.min("position").alias("position"), F.max_by("value", "position").alias("value"))
