"""Registered queries of sessions, trees, archives and responses, each over its whole tables, with SQL that states the wanted result.

Where the tables hold no input for an operator (keys to look up, damaged
archives, model responses), the query plants some by key with the same
expression as its SQL; what must come out is written down in the SQL by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import messages as M
from loomline.functions import text as T
from loomline.functions import values as V
from loomline.operators import capsule, constraints, ledger, line_archive, merge, ordering, records, responses, segments, session_build, trees
from loomline.queries import query
from loomline.reference_queries import ENTRIES_SQL, MESSAGES_SQL, size_sql
from loomline.runtime import read, shared_root
from loomline.sources import jsonl
from loomline.sources import sessions as S

WS = T.WS


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry of the live sessions."""
    return M.distinct_entries(read(spark, sf_dir, "session_entries"))


HASH = "left(sha256({}), 16)"
MERGED_SQL = f"""
WITH {ENTRIES_SQL},
i AS (SELECT source_id, min(source_index) AS source_index FROM session_entries WHERE source_id IS NOT NULL GROUP BY source_id),
t AS (SELECT {HASH.format("e.source_id || chr(10) || e.entry_id")} AS new_id,
    CASE WHEN coalesce(e.parent_id, '') = '' THEN {HASH.format("e.source_id")} WHEN p.entry_id IS NOT NULL THEN {HASH.format("e.source_id || chr(10) || e.parent_id")} END AS new_parent_id,
    e.source_id, e.line_index, e.entry_id, e.entry_type, CASE WHEN coalesce(e.parent_id, '') <> '' AND p.entry_id IS NULL THEN 'no parent' END AS fault
  FROM e LEFT JOIN e p ON p.source_id = e.source_id AND p.entry_id = e.parent_id WHERE e.source_id IS NOT NULL)
"""


@query(
    MERGED_SQL
    + f"""SELECT new_id, new_parent_id, source_id, line_index, entry_id, entry_type, fault FROM t
UNION ALL SELECT {HASH.format("source_id")}, 'root', source_id, -1, NULL, 'source_root', NULL FROM (SELECT DISTINCT source_id FROM t)"""
)
def merged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all sessions under one root, with new ids."""
    return trees.merged(entries(spark, sf_dir)).drop("source_index")


@query(MERGED_SQL + "SELECT source_id, entry_id, CASE line_index % 97 WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' ELSE 'wrong parent' END AS fault FROM t WHERE line_index % 97 IN (1, 2, 3)")
def merge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a merged tree of which some rows were left out, changed or hung elsewhere."""
    rows = entries(spark, sf_dir)
    slot = F.col("line_index") % 97
    spoiled = trees.merged(rows).filter("line_index < 0 or line_index % 97 <> 1").withColumn("entry_type", F.when(slot == 2, "?").otherwise(F.col("entry_type"))).withColumn("new_parent_id", F.when(slot == 3, "elsewhere").otherwise(F.col("new_parent_id")))
    return trees.merge_faults(spoiled, rows)


@query(
    f"""WITH {MESSAGES_SQL}, r AS (SELECT source_id, entry_id, line_index, role, calls FROM m WHERE entry_type = 'message' AND role IS NOT NULL),
b AS (SELECT source_id, coalesce(max(line_index) FILTER (role = 'user'), max(line_index) FILTER (role = 'assistant' AND calls), -1) AS start FROM r GROUP BY source_id)
SELECT source_id, entry_id, line_index FROM r JOIN b USING (source_id) WHERE line_index >= start"""
)
def authoritative_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each session from its last request on."""
    return trees.authoritative_tail(read(spark, sf_dir, "session_entries"))


@query(
    f"""WITH {MESSAGES_SQL}, r AS (SELECT source_id, entry_id, line_index, coalesce(role = 'toolResult', false) AS result, coalesce(role = 'assistant' AND calls, false) AS calls FROM m WHERE entry_type = 'message'),
h AS (SELECT *, max(CASE WHEN NOT result THEN line_index END) OVER (PARTITION BY source_id ORDER BY line_index, entry_id ROWS UNBOUNDED PRECEDING) AS head FROM r)
SELECT h.source_id, h.entry_id, h.line_index, CASE WHEN h.result AND coalesce(x.calls, false) THEN h.head ELSE h.line_index END AS transaction
FROM h LEFT JOIN r x ON x.source_id = h.source_id AND x.line_index = h.head AND NOT x.result"""
)
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and their results as one transaction each."""
    return trees.transactions(read(spark, sf_dir, "session_entries"))


@query(
    """WITH h AS (SELECT record_id, raw_text, CASE WHEN record_id % 2 = 0 THEN CASE WHEN json_valid(raw_text) THEN raw_text->>'$.id' END ELSE 'other' END AS expected FROM raw_records WHERE record_kind = 'header'),
s AS (SELECT *, CASE WHEN raw_text IS NULL OR NOT json_valid(raw_text) THEN 'unreadable' WHEN json_type(raw_text) <> 'OBJECT' OR coalesce(raw_text->>'$.type', '') <> 'session' THEN 'no session header'
  WHEN coalesce(raw_text->>'$.id', '') <> expected OR expected IS NULL THEN 'another id' ELSE 'ok' END AS status FROM h)
SELECT record_id, status, CASE WHEN status = 'ok' THEN coalesce(TRY_CAST(raw_text->>'$.version' AS INT), 1) END AS version FROM s"""
)
def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header line against the id expected of it."""
    own = F.try_variant_get(T.whole_json("raw_text"), "$.id", "string")
    rows = read(spark, sf_dir, "raw_records").filter("record_kind = 'header'").withColumn("expected", F.when(F.col("record_id") % 2 == 0, own).otherwise("other"))
    status, version = S.header_status(F.col("raw_text"), F.col("expected"))
    return rows.select("record_id", status.alias("status"), version.alias("version"))


@query(
    """WITH l AS (SELECT source_path, source_id || '-local' AS source_id FROM sessions WHERE created_ms % 3 = 0),
n AS (SELECT '/local/' || source_id || '.jsonl' AS source_path, source_id || '-new' AS source_id FROM sessions WHERE created_ms % 3 = 1)
SELECT source_path AS path, source_id FROM l UNION ALL SELECT * FROM n UNION ALL SELECT source_path, source_id FROM sessions WHERE source_path NOT IN (SELECT source_path FROM l)"""
)
def discovered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and local sessions, one per path however it is written."""
    known = read(spark, sf_dir, "sessions").select("source_path", "source_id", "created_ms")
    same = known.filter("created_ms % 3 = 0").select(F.concat(F.lit("/x/..//."), "source_path").alias("source_path"), F.concat("source_id", F.lit("-local")).alias("source_id"))
    new = known.filter("created_ms % 3 = 1").select(F.concat(F.lit("/local/./"), "source_id", F.lit(".jsonl")).alias("source_path"), F.concat("source_id", F.lit("-new")).alias("source_id"))
    return S.discovered(known.drop("created_ms"), same.unionByName(new)).select("path", "source_id")


@query(
    """WITH o AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS turn FROM sessions),
a AS (SELECT turn, CASE WHEN turn % 7 = 0 THEN '/else' ELSE '/w' END AS place, CASE turn % 6 WHEN 0 THEN upper(source_id) WHEN 1 THEN left(source_id, 6) WHEN 2 THEN left(source_id, 2) WHEN 3 THEN 'zz' WHEN 4 THEN ' ' ELSE source_id END AS key FROM o),
k AS (SELECT *, lower(trim(key)) AS k FROM a),
f AS (SELECT k.*, (SELECT count(*) FROM sessions s WHERE s.source_id = k.k) AS n, (SELECT count(*) FROM sessions s WHERE starts_with(s.source_id, k.k)) AS b, (SELECT min(source_id) FROM sessions s WHERE starts_with(s.source_id, k.k)) AS hit FROM k),
g AS (SELECT *, CASE WHEN k = '' THEN 'empty' WHEN b = 0 THEN 'none' WHEN n <> 1 AND b > 1 THEN 'ambiguous' WHEN place <> '/w' THEN 'other cwd' END AS first FROM f)
SELECT turn, key, CASE WHEN first IS NULL OR first = 'other cwd' THEN hit END AS source_id,
  coalesce(first, CASE WHEN turn > min(turn) FILTER (first IS NULL) OVER (PARTITION BY place, hit) THEN 'repeated' END, 'ok') AS status FROM g"""
)
def resolved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, upper-case and shortened ids looked up among all sessions."""
    known = read(spark, sf_dir, "sessions").select("source_id", F.lit("/w/").alias("cwd"))
    turn = ordering.global_position(known, [F.col("source_id")], "turn").withColumn("turn", F.col("turn").cast("long"))
    n, i = F.col("turn") % 6, F.col("source_id")
    key = F.when(n == 0, F.upper(i)).when(n == 1, F.left(i, F.lit(6))).when(n == 2, F.left(i, F.lit(2))).when(n == 3, "zz").when(n == 4, " ").otherwise(i)
    asked = turn.select("turn", F.when(F.col("turn") % 7 == 0, "/else").otherwise("/w/./").alias("cwd"), key.alias("key"))
    return S.resolved_ids(known, asked).drop("cwd")


@query(
    f"""WITH {ENTRIES_SQL}, d AS (SELECT 'pi' AS source, left(source_id, 2) AS import_id FROM sessions WHERE parent_session IS NOT NULL),
i AS (SELECT 'pi' AS source, left(source_id, 3) AS import_id FROM session_entries WHERE entry_type = 'custom' AND custom_type = 'import_source' AND entry_id <> '')
SELECT source, import_id, max(direct) AS direct FROM (SELECT *, true AS direct FROM d UNION ALL SELECT *, false FROM i) GROUP BY ALL"""
)
def import_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported sources named directly or by entries, each once."""
    direct = read(spark, sf_dir, "sessions").filter("parent_session is not null").select(F.lit("pi").alias("source"), F.left("source_id", F.lit(2)).alias("import_id"), F.lit(0).alias("turn"))
    data = F.to_json(F.struct(F.lit("pi").alias("source"), F.left("source_id", F.lit(3)).alias("sourceId")))
    return S.import_sources(direct, entries(spark, sf_dir).withColumn("data", data)).select("source", "import_id", (F.col("first.list") == 0).alias("direct"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as those of a file."""
    d = read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "text")
    return d.select("source_id", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "raw")).withColumn("line_index", F.col("line_index").cast("long"))


PER_CHUNK = 5


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE doc_id % 10 WHEN 1 THEN 'chunk missing' WHEN 2 THEN 'chunk damaged' WHEN 3 THEN 'line hash' ELSE 'line count' END AS fault
FROM documents WHERE text IS NOT NULL AND doc_id % 10 IN (1, 2, 3, 4)"""
)
def archive_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all documents of which some lost a chunk, a byte, a record's hash or a count: every one is found, no other."""
    lines = document_lines(spark, sf_dir)
    slot = F.col("source_id").cast("long") % 10
    whole = line_archive.chunks(lines.drop("doc_id"), PER_CHUNK)
    first = F.col("chunk_index") == 0
    spoiled = whole.filter(~((slot == 1) & first)).withColumn("data", F.when((slot == 2) & first, F.lit("eA==")).otherwise(F.col("data")))
    sources = line_archive.manifest(whole).withColumn("line_count", F.col("line_count") + (slot == 4).cast("long"))
    records = line_archive.timeline(lines.drop("doc_id")).withColumn("raw_line_sha256", F.when((slot == 3) & (F.col("line_index") == 0), "0").otherwise(F.col("raw_line_sha256")))
    return line_archive.faults(spoiled, sources, records, PER_CHUNK)


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k // {PER_CHUNK} AS chunk, sha256(string_agg(raw, chr(10) ORDER BY k)) AS h FROM l GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS source_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS line_count, strlen(text) AS bytes, count(*) AS chunk_count, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS sha256
FROM documents d JOIN c USING (doc_id) GROUP BY doc_id, text"""
)
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of an archive of all documents."""
    return line_archive.manifest(line_archive.chunks(document_lines(spark, sf_dir).drop("doc_id"), PER_CHUNK))


TIMES = "CASE record_id % 6 WHEN 0 THEN '{\"timestamp\":\"2025-01-02T03:04:05Z\"}' WHEN 1 THEN '{\"timestamp\":1700000000123}' WHEN 2 THEN '{\"timestamp\":null,\"message\":{\"timestamp\":\"soon\"}}' WHEN 3 THEN '{\"message\":{\"timestamp\":5}}' WHEN 4 THEN '{\"message\":[1]}' ELSE raw_text END"


@query(
    """SELECT record_id, CASE record_id % 6 WHEN 0 THEN 1735787045000 WHEN 1 THEN 1700000000123 WHEN 3 THEN 5
  WHEN 5 THEN CASE WHEN json_valid(raw_text) THEN CASE json_type(raw_text, '$.timestamp') WHEN 'VARCHAR' THEN epoch_ms(TRY_CAST(raw_text->>'$.timestamp' AS TIMESTAMPTZ)) WHEN 'UBIGINT' THEN CAST(raw_text->>'$.timestamp' AS BIGINT) END END END AS ms FROM raw_records"""
)
def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each line, written as number or text, on the line or in its message."""
    rows = read(spark, sf_dir, "raw_records").withColumn("raw", F.expr(TIMES))
    return rows.select("record_id", V.any_millis(V.record_time(F.col("raw"))).alias("ms"))


@query(
    """WITH RECURSIVE r AS (SELECT record_id, CAST(raw_text AS JSON) AS j FROM raw_records WHERE json_valid(raw_text)),
w AS (SELECT record_id, j FROM r UNION ALL
  SELECT record_id, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: json_extract(j, '$."' || k || '"')) WHEN 'ARRAY' THEN json_extract(j, '$[*]') END) FROM w WHERE json_type(j) IN ('OBJECT', 'ARRAY'))
SELECT record_id, count(*) FILTER (json_type(j) = 'VARCHAR' AND (j->>'$') = 'handoff') AS n FROM w GROUP BY record_id"""
)
def exact_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one string stands as a value at any depth of each record."""
    return read(spark, sf_dir, "raw_records").select("record_id", V.count_exact("handoff")(F.col("raw_text")).alias("n")).filter("n is not null")


LOOSE = ("true", "1", "2", '" Yes "', '"n"', '""', '"maybe"', "[]", "null", '"0.25"', '"7"', "0.5", "1.5", '"x"')
LOOSE_SQL = "CASE segment_id % 14 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LOOSE)) + " END"


@query(
    """SELECT segment_id, CASE segment_id % 14 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN false WHEN 8 THEN false WHEN 11 THEN false WHEN 12 THEN false END AS truth,
  CASE segment_id % 14 WHEN 1 THEN 1.0 WHEN 5 THEN 0.9 WHEN 8 THEN 0.9 WHEN 9 THEN 0.25 WHEN 10 THEN 1.0 WHEN 11 THEN 0.5 END AS confidence FROM visible_segments"""
)
def loose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values read as truth and as confidence."""
    v = read(spark, sf_dir, "visible_segments").select("segment_id", F.expr(LOOSE_SQL).alias("v"))
    return v.select("segment_id", V.loose_bool(F.col("v")).alias("truth"), V.confidence(F.col("v")).alias("confidence"))


# Planted words with what they must become, written down by hand.
CATEGORY = (("state", "state"), ("Current-State", "state"), ("ability", "capability"), ("ENTRY", "entry_point"), ("choice", "decision"), ("constant", "invariant"), ("bug", "failure"), ("patch", "fix"), ("verify", "verification"), (" limit ", "constraint"), ("todo", "open_work"), ("strange", "state"), ("", "state"))
STATUS = (("Active", "current"), ("present", "current"), ("done", "historical"), ("replaced", "superseded"), ("unresolved", "unresolved"), ("odd", "unresolved"), ("now", "current"))
CONFIDENCE = (("HIGH", "verified"), ("known", "verified"), ("inferred", "inferred"), ("guess", "inferred"), ("definite", "verified"))


def pick(table: tuple, column: int) -> str:
    """A SQL choice from a planted table by segment."""
    return f"CASE segment_id % {len(table)} " + " ".join(f"WHEN {k} THEN '{row[column]}'" for k, row in enumerate(table)) + " END"


REF_SQL = "CASE segment_id % 5 WHEN 0 THEN source_id WHEN 1 THEN upper(source_id) WHEN 2 THEN left(source_id, 9) WHEN 3 THEN source_id || '-tail' ELSE 'nothing' END"


def planted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact per segment, its words and references planted."""
    s = read(spark, sf_dir, "visible_segments").filter("source_id is not null")
    return s.select(
        F.col("source_id").alias("ledger_id"), F.concat(F.lit("f"), "segment_id").alias("fact_id"), F.expr(pick(CATEGORY, 0)).alias("category"), F.expr(pick(STATUS, 0)).alias("status"), F.expr(pick(CONFIDENCE, 0)).alias("confidence"),
        F.lit(" said ").alias("statement"), F.expr(REF_SQL).alias("ref"), "segment_id", F.concat(F.lit("d"), (F.col("segment_id") % 3).cast("string")).alias("domain"),
    )


@query(
    f"""SELECT source_id AS ledger_id, 'f' || segment_id AS fact_id, {pick(CATEGORY, 1)} AS category, {pick(STATUS, 1)} AS status, {pick(CONFIDENCE, 1)} AS confidence,
  CASE WHEN segment_id % 5 = 4 THEN 'nothing' ELSE source_id END AS source_id FROM visible_segments WHERE source_id IS NOT NULL"""
)
def uniform_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with canonical words and the sources they mean."""
    facts = planted_facts(spark, sf_dir)
    expected = facts.select("ledger_id", F.col("ledger_id").alias("source_id")).distinct()
    meant = capsule.resolved_sources(facts.select("ledger_id", "fact_id", "ref"), expected).select("ledger_id", "fact_id", "source_id")
    return capsule.uniform_facts(facts).select("ledger_id", "fact_id", "category", "status", "confidence").join(meant, ["ledger_id", "fact_id"])


@query(
    f"""WITH f AS (SELECT source_id AS ledger_id, 'f' || segment_id AS fact_id, {pick(CATEGORY, 1)} AS category, {pick(STATUS, 1)} AS status FROM visible_segments WHERE source_id IS NOT NULL)
SELECT ledger_id, fact_id FROM f WHERE status IN ('current', 'unresolved') OR category IN ('decision', 'invariant', 'entry_point', 'constraint', 'open_work')"""
)
def required_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that a review must cite."""
    return capsule.required_facts(capsule.uniform_facts(planted_facts(spark, sf_dir))).select("ledger_id", "fact_id")


@query(
    """WITH d AS (SELECT DISTINCT source_id AS ledger_id, 'd' || (segment_id % 3) AS domain FROM visible_segments WHERE source_id IS NOT NULL),
j AS (SELECT ledger_id, string_agg(domain, '+' ORDER BY domain) AS joined FROM d GROUP BY ledger_id)
SELECT ledger_id, joined, domain, 'undeclared' AS fault FROM d JOIN j USING (ledger_id) WHERE domain = 'd2' UNION ALL
SELECT ledger_id, joined, x, 'unused' FROM j, (VALUES ('d0'), ('d1'), ('dx')) v(x) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.ledger_id = j.ledger_id AND domain = x)"""
)
def domain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers that declare the domains d0, d1 and dx: what they do not use, and what they use besides."""
    facts = planted_facts(spark, sf_dir)
    declared = facts.select("ledger_id").distinct().select("ledger_id", F.explode(F.array(F.lit("d0"), F.lit("d1"), F.lit("dx"))).alias("domain"))
    return capsule.domain_faults(facts, declared).join(capsule.joined_domain(facts).withColumnRenamed("domain", "joined"), "ledger_id")


@query(
    """SELECT segment_id, CASE segment_id % 8 WHEN 1 THEN 'id' WHEN 2 THEN 'subject' WHEN 3 THEN 'domain' WHEN 4 THEN 'statement' WHEN 5 THEN 'statement' WHEN 6 THEN 'date' ELSE 'statement' END AS fault
FROM visible_segments WHERE segment_id % 8 <> 0"""
)
def fact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted facts with one thing wrong each, and sound ones."""
    slot = F.col("segment_id") % 8
    s = read(spark, sf_dir, "visible_segments")
    facts = s.select(
        F.lit("l").alias("ledger_id"), F.when(slot == 1, F.lit("-bad")).otherwise(F.col("segment_id").cast("string")).alias("fact_id"), F.when(slot == 2, "a/b").otherwise("Sub ject:1#x").alias("subject"),
        F.when(slot == 3, F.lit("")).otherwise("dom-1").alias("domain"), F.when(slot == 4, "two\nlines").when(slot == 5, F.repeat(F.lit("x"), F.lit(801))).when(slot == 7, "  ").otherwise("said").alias("statement"),
        F.when(slot == 6, F.lit("  ")).otherwise("2025").alias("as_of"), "segment_id",
    )
    found = capsule.fact_faults(facts.withColumn("ledger_id", F.col("segment_id").cast("string")))
    return found.select(F.col("ledger_id").cast("long").alias("segment_id"), "fault")


BODY = "\n".join(f"{h}\nbody of it\n" for h in capsule.HEADINGS)
LONG = "This paragraph has more than eighty characters, so that it counts when paragraphs are compared with each other."
#: (title, domain, text, fault) of planted summaries.
CAPSULES = (
    ("t", "d", BODY, None), (" ", "d", BODY, "title"), ("t", "Ambiguous", BODY, "domain"), ("t", "d", BODY.replace(capsule.HEADINGS[1] + "\n", ""), "headings"), ("t", "d", BODY.replace("body of it", " ", 1), "empty section"),
    ("t", "d", BODY + "see cleanup_manifest", "provenance"), ("t", "d", f"{BODY}\n{LONG}\n\nbetween\n\n{LONG}\n", "repeated paragraph"), ("t", "d", BODY + "\n```\nopen", "open fence"), ("t", "d", "x" * 12_001, "size"),
    ("t", "d", BODY + "\n## More\nx", "headings"), ("t", "d", BODY + "\n" + LONG, None),
)


def planted(table: tuple, column: int):
    """The value of a planted table by segment, as a column."""
    out, slot = F.lit(None).cast("string"), F.col("segment_id") % len(table)
    for k, row in enumerate(table):
        out = F.when(slot == k, F.lit(row[column])).otherwise(out)
    return out


def fault_sql(table: tuple) -> str:
    """The hand-written faults of a planted table in SQL."""
    return f"CASE segment_id % {len(table)} " + " ".join(f"WHEN {k} THEN {repr(row[-1]) if row[-1] else 'NULL'}" for k, row in enumerate(table)) + " END"


@query(f"SELECT segment_id, {fault_sql(CAPSULES)} AS fault, CASE WHEN segment_id % 11 = 1 THEN '清洗后的会话摘要' ELSE 't' END AS title, CASE WHEN segment_id % 11 = 2 THEN 'src' ELSE 'd' END AS domain FROM visible_segments")
def capsule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted summaries checked, and made to fit."""
    rows = read(spark, sf_dir, "visible_segments").select("segment_id", planted(CAPSULES, 0).alias("t"), planted(CAPSULES, 1).alias("d"), planted(CAPSULES, 2).alias("m"), F.array(F.lit("src")).alias("s"))
    parts = F.col("t"), F.col("d"), F.col("m"), F.col("s")
    fit = rows.select("segment_id", capsule.capsule_fault(*parts).alias("fault"), capsule.lenient_capsule(*parts).alias("c"))
    return fit.select("segment_id", "fault", "c.title", "c.domain")


def review(scores: dict | None = None, **changes) -> str:
    """A sound review with some parts changed."""
    import json

    points = dict.fromkeys(capsule.CRITERIA, 4) | (scores or {})
    told = {"pass": True, "scores": points, "evidence": [{"criterion": c, "section": "Open Work", "factIds": ["f1", "f2"]} for c in capsule.CRITERIA], "issues": [], "rewriteInstructions": ""}
    return json.dumps(told | changes)


EVIDENCE = [{"criterion": c, "section": "## Open Work", "factIds": ["f1"]} for c in capsule.CRITERIA]
#: (review, fault) of planted reviews.
REVIEWS = (
    (review(), None), (review({"concision": 6}), "scores"), (review({"concision": 3.5}), "scores"), (review(evidence=EVIDENCE[:5]), "evidence"), (review(evidence=[*EVIDENCE[:5], EVIDENCE[0]]), "evidence"), (review(evidence=EVIDENCE), "required facts"),
    (review({"concision": 3}), "pass and scores"), (review(issues=["bad"]), "issues and pass"), (review({"concision": 3}, **{"pass": False}), "issues and pass"),
    (review({"concision": 2}, **{"pass": False}, issues=["wordy"], rewriteInstructions="shorten"), None), (review(**{"pass": None}), "pass"), (review(issues=[" "]), "issues"),
)


@query(f"SELECT segment_id, {fault_sql(REVIEWS)} AS fault FROM visible_segments")
def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted reviews checked."""
    ids = F.array(F.lit("f1"), F.lit("f2"))
    return read(spark, sf_dir, "visible_segments").select("segment_id", capsule.review_fault(planted(REVIEWS, 0), ids, ids).alias("fault"))


PACK_SQL = """RECURSIVE b AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY source_order, segment_id) AS n, segment_id, text, {size} AS size FROM visible_segments WHERE text IS NOT NULL),
p AS (SELECT source_id, n, segment_id, text, size AS used, CAST(1 AS BIGINT) AS chunk FROM b WHERE n = 1
  UNION ALL SELECT b.source_id, b.n, b.segment_id, b.text, CASE WHEN p.used + b.size + 2 > {most} THEN b.size ELSE p.used + b.size + 2 END, p.chunk + CASE WHEN p.used + b.size + 2 > {most} THEN 1 ELSE 0 END
  FROM p JOIN b ON b.source_id IS NOT DISTINCT FROM p.source_id AND b.n = p.n + 1)"""


def packed(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """Segments packed per source."""
    s = read(spark, sf_dir, "visible_segments").filter("text is not null").select("source_id", "source_order", "segment_id", "text", T.utf16_length(F.col("text")).alias("size"))
    return segments.pack(s, "source_id", ["source_order", "segment_id"], "size", most=most)


@query(
    f"""WITH {PACK_SQL.format(size=size_sql('text'), most=60)}, c AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS blocks, max(chunk) OVER (PARTITION BY source_id) AS top FROM p)
SELECT segment_id, CASE WHEN blocks > 1 AND blocks = top THEN (chunk - 1) // 2 + 1 ELSE chunk END AS reduce_group FROM c"""
)
def reduction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks grouped for one round of merging: packed, or in pairs where nothing fits together."""
    return capsule.reduction_groups(packed(spark, sf_dir, 60), "source_id", ["source_order", "segment_id"]).select("segment_id", "reduce_group")


@query(
    f"""WITH {PACK_SQL.format(size=size_sql('text'), most=2000)}, c AS (SELECT source_id, chunk, string_agg(text, chr(10) || chr(10) ORDER BY n) AS content FROM p GROUP BY ALL),
d AS (SELECT *, coalesce(source_id, '') AS s, max(chunk) OVER (PARTITION BY source_id) AS many, sha256(content) AS content_hash FROM c),
i AS (SELECT *, s || '#handoff-chunk-' || chunk || '-of-' || many AS coverage_id FROM d)
SELECT source_id, chunk, coverage_id, s || '#active-branch-chunk-' || chunk || '-of-' || many AS locator, content_hash, 'EVD-' || left(sha256(lower(trim(s || chr(10) || coverage_id || chr(10) || content_hash, ' ' || chr(10)))), 10) AS evidence_id FROM i"""
)
def chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage ids and evidence rows of all packed chunks."""
    return capsule.chunk_evidence(packed(spark, sf_dir, 2_000), "text", ["source_order", "segment_id"]).drop("content")


@query(
    """WITH f AS (SELECT coalesce(source_id, '') AS ref, seg_kind AS summary, segment_id AS position, left(text, 3) AS value FROM visible_segments)
SELECT ref, summary, min(position) AS position, max_by(struct_pack(v := value), position).v AS value FROM f GROUP BY ALL"""
)
def flags_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag per segment, each reference and kind once: first position, last value."""
    return capsule.flags_once(read(spark, sf_dir, "visible_segments").select(F.coalesce("source_id", F.lit("")).alias("ref"), F.col("seg_kind").alias("summary"), F.col("segment_id").alias("position"), F.left("text", F.lit(3)).alias("value")))


@query("SELECT 'c' || segment_id AS id FROM visible_segments WHERE segment_id % 10 IN (6, 9)")
def constraint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hard constraint per segment and a successor that retains, supersedes or ignores it: those carried over."""
    n = F.col("segment_id").cast("string")
    slot, told = F.col("segment_id") % 10, F.concat(F.lit("Statement number "), n, F.lit(" keep"))
    s = read(spark, sf_dir, "visible_segments").select("segment_id")
    none, some = F.array().cast("array<string>"), F.array(F.lit("e1"))
    old = s.select(F.concat(F.lit("c"), n).alias("id"), told.alias("statement"), F.when(slot == 7, "soft").otherwise("hard").alias("level"), F.when(slot == 8, "inactive").otherwise("active").alias("status"), F.lit(None).cast("string").alias("supersedes"), none.alias("evidence"))
    ends = F.when(slot.isin(2, 6), F.concat(F.lit("c"), n)).when(slot == 3, F.upper(told)).when(slot == 4, F.concat(F.lit("no longer: "), told, F.lit(" at all"))).when(slot == 5, F.concat(F.lit("number "), n, F.lit(" keep")))
    text = F.when(slot == 1, F.concat(F.lit(" statement NUMBER"), n, F.lit("，keep。"))).otherwise(F.concat(F.lit("new "), n))
    new = s.select(F.concat(F.when(slot == 0, "c").otherwise("n"), n).alias("id"), text.alias("statement"), F.lit("hard").alias("level"), F.lit("active").alias("status"), ends.alias("supersedes"), F.when(slot == 6, none).otherwise(some).alias("evidence"))
    return constraints.preserved(old, new).filter("inherited").select("id")


@query("SELECT source_id, count(*) FILTER (entry_id <> source_id OR line_index > 0) AS entries, min(line_index) AS first_line, max(line_index) AS last_line FROM (SELECT source_id, entry_id, dense_rank() OVER (PARTITION BY source_id ORDER BY line_index, entry_id) AS line_index FROM (SELECT source_id, entry_id, max(line_index) AS line_index FROM session_entries WHERE entry_type <> 'session' AND entry_id <> '' GROUP BY ALL)) GROUP BY source_id")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions written as files and read back: entries and places of each."""
    rows = entries(spark, sf_dir).filter("entry_type <> 'session' and source_id is not null")
    placed = ordering.position_in_group(rows.select("source_id", "entry_id", "parent_id", "entry_type", "line_index"), "source_id", [F.col("line_index"), F.col("entry_id")], "place")
    body = placed.select("source_id", F.col("place").cast("long").alias("line_index"), F.to_json(F.struct(F.col("entry_type").alias("type"), F.col("entry_id").alias("id"), F.col("parent_id").alias("parentId"))).alias("raw"))
    head = rows.select("source_id").distinct().select("source_id", F.lit(0).cast("long").alias("line_index"), F.to_json(F.struct(F.lit("session").alias("type"), F.col("source_id").alias("id"), F.lit(3).alias("version"))).alias("raw"))
    path = f"{shared_root(spark)}/loomline-files-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    jsonl.write_lines(head.unionByName(body), path, mode="overwrite")
    read_back = jsonl.read_sessions(spark, f"{path}/*/*.txt", exact=True)[1]
    return read_back.groupBy("source_id").agg(F.count("*").alias("entries"), F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"))


@query()
def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept turns of all sessions as texts."""
    return records.rendered(read(spark, sf_dir, "session_entries"))


@query()
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much smaller each session is as rendered records, its latest summary before them."""
    e = read(spark, sf_dir, "session_entries")
    return records.size_stats(records.with_summary(records.rendered(e), e), e)


@query(
    """WITH s AS (SELECT source_id, source_order, segment_id, text FROM visible_segments WHERE source_id IS NOT NULL AND text <> ''),
t AS (SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY segment_id) AS body FROM s GROUP BY source_id)
SELECT source_id, sha256(body) AS body_hash, CAST(4 AS BIGINT) AS lines, CASE WHEN left(source_id, 1) = '0' THEN 'cleanup_ir not once' WHEN left(source_id, 1) = '1' THEN 'broken chain' END AS fault FROM t"""
)
def built_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions built around their segments, some spoiled, and what the check of each finds."""
    s = read(spark, sf_dir, "visible_segments").filter("source_id is not null and text <> ''").select("source_id", F.col("segment_id").alias("source_order"), "seg_kind", "text", "fidelity")
    made = session_build.built(session_build.stored_results(s, "policy"), F.struct(F.lit(3).alias("schemaVersion"), F.lit("textual").alias("mode")))
    first = F.left("source_id", F.lit(1))
    twice = made.unionByName(made.filter((first == "0") & (F.col("custom_type") == "cleanup_ir")))
    spoiled = twice.withColumn("parent_id", F.when((first == "1") & (F.col("line_index") == 3), "elsewhere").otherwise(F.col("parent_id")))
    hashes = made.filter("custom_type = 'cleanup_ir'").select("source_id", F.try_variant_get(T.whole_json("raw"), "$.data.outputContentHash", "string").alias("body_hash"))
    sizes = made.groupBy("source_id").agg(F.count("*").alias("lines"))
    return hashes.join(sizes, "source_id").join(session_build.build_faults(spoiled), "source_id", "left")


@query("SELECT segment_id FROM visible_segments WHERE segment_id % 5 = 0 AND text IS NOT NULL")
def secret_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments, every fifth with a planted false key, that may not be published."""
    s = read(spark, sf_dir, "visible_segments").select("segment_id", F.when(F.col("segment_id") % 5 == 0, F.concat("text", F.lit(" sk-fakefakefakefake0000"))).otherwise(F.col("text")).alias("text"))
    return session_build.secret_shaped(s, "text").select("segment_id")


@query(
    """WITH e AS (SELECT source_id, entry_id, any_value(line_index) AS n FROM session_entries WHERE entry_id <> '' GROUP BY ALL)
SELECT source_id, CAST(sum(CASE WHEN n % 3 <> 2 THEN n ELSE 0 END) AS DOUBLE) AS input, CAST(sum(CASE WHEN n % 3 = 0 THEN 0.5 * n ELSE 0 END) AS DOUBLE) AS cost_total FROM e GROUP BY source_id"""
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of planted usage per session; a third of the messages report none or no number."""
    n = F.col("line_index")
    told = F.when(n % 3 == 0, F.to_json(F.struct(F.struct(n.alias("input"), F.struct((n * 0.5).alias("total")).alias("cost")).alias("usage")))).when(n % 3 == 1, F.concat(F.lit('{"usage":{"input":'), n.cast("string"), F.lit(',"cost":"none"}}'))).otherwise('{"usage":{"input":"many"}}')
    return session_build.usage_totals(entries(spark, sf_dir).select("source_id", told.alias("message"))).select("source_id", "input", "cost_total")


NUMBERED_SQL = "SELECT source_id, row_number() OVER (ORDER BY source_id) AS n FROM sessions"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their number in order of id, as ``n``."""
    return ordering.global_position(read(spark, sf_dir, "sessions").select("source_id"), [F.col("source_id")], "n").withColumn("n", F.col("n").cast("long"))


@query(f"SELECT source_id || '-left' AS \"left\", source_id || '-right' AS \"right\", n % 6 AS overlap FROM ({NUMBERED_SQL})")
def planted_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources a session, of eight segments each, the second beginning with the last n % 6 of the first in another spelling of white space."""
    sessions = numbered(spark, sf_dir)
    s = sessions.select("source_id", (F.col("n") % 6).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    left = s.select(F.concat("source_id", F.lit("-left")).alias("source"), "i", F.concat_ws(" ", "source_id", F.lit("line"), F.col("i").cast("string")).alias("text"))
    again = F.concat_ws("  ", "source_id", F.lit("line"), (8 - F.col("k") + F.col("i")).cast("string"))
    right = s.select(F.concat("source_id", F.lit("-right")).alias("source"), "i", F.when(F.col("i") < F.col("k"), again).otherwise(F.concat_ws(" ", F.lit("own"), "source_id", F.col("i").cast("string"))).alias("text"))
    rows = segments.signed(left.unionByName(right).withColumn("seg_kind", F.lit("user"))).select("source", F.col("i").cast("long").alias("place"), "signature")
    pairs = sessions.select(F.concat("source_id", F.lit("-left")).alias("left"), F.concat("source_id", F.lit("-right")).alias("right"))
    return merge.overlaps(pairs, rows)


@query(f"SELECT 2 * n + n % 6 AS segment_id, 2 * n + 1 - n % 6 AS kept_id FROM ({NUMBERED_SQL}) WHERE n % 6 < 2")
def boundary_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring segments a session: a near repeat, longer or shorter, or one kept apart by length, kind, code or a common source."""
    k, first = F.col("n") % 6, F.repeat(F.col("source_id"), F.lit(3))
    second = F.when(k == 0, F.concat(first, F.lit("!!"))).when(k == 1, F.expr("left(repeat(source_id, 3), 107)")).when(k == 2, F.expr("left(repeat(source_id, 3), 80)")).when(k == 4, F.concat(first, F.lit("\n```"))).otherwise(first)
    s = numbered(spark, sf_dir)
    one = s.select(F.col("source_id").alias("family"), (2 * F.col("n")).alias("segment_id"), F.lit("a").alias("source_id"), F.lit("user").alias("seg_kind"), first.alias("text"))
    two = s.select(F.col("source_id").alias("family"), (2 * F.col("n") + 1).alias("segment_id"), F.when(k == 5, "a").otherwise("b").alias("source_id"), F.when(k == 3, "tool").otherwise("user").alias("seg_kind"), second.alias("text"))
    return merge.boundary_near(one.unionByName(two), "family", ["segment_id"])


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, 0 AS k, '' AS part, text AS rest FROM documents WHERE text IS NOT NULL AND len(text) > 300
  UNION ALL SELECT doc_id, k + 1, left(rest, cut), CASE WHEN len(rest) > 300 THEN ltrim(substr(rest, cut + 1), chr(10)) ELSE '' END
  FROM (SELECT *, CASE WHEN len(rest) <= 300 THEN len(rest) WHEN near < 150 THEN 300 ELSE near END AS cut FROM (
    SELECT *, CASE WHEN contains(left(rest, 301), chr(10)) THEN 301 - strpos(reverse(left(rest, 301)), chr(10)) ELSE -1 END AS near FROM r WHERE rest <> ''))),
p AS (SELECT doc_id, k, part, max(k) OVER (PARTITION BY doc_id) AS many FROM r WHERE k > 0)
SELECT doc_id, k AS place, '[oversized block part ' || k || '/' || many || ']' || chr(10) || part AS part FROM p
UNION ALL SELECT doc_id, 1, text FROM documents WHERE text IS NOT NULL AND len(text) <= 300"""
)
def oversized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at line ends into labelled parts of at most 300 units."""
    d = read(spark, sf_dir, "documents").filter("text is not null").withColumn("parts", segments.oversized_parts(300)("text"))
    return d.select("doc_id", F.posexplode("parts").alias("place", "part")).withColumn("place", (F.col("place") + 1).cast("int"))


@query(
    """SELECT segment_id, CASE segment_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not stopped' WHEN 2 THEN 'fenced' WHEN 3 THEN 'no JSON' WHEN 4 THEN 'no object' ELSE 'not stopped' END AS fault,
  CASE WHEN segment_id % 6 = 0 THEN '{"n":' || segment_id || '}' END AS object FROM visible_segments"""
)
def strict_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted responses, one kind of fault each."""
    n, slot = F.col("segment_id").cast("string"), F.col("segment_id") % 6
    whole = F.concat(F.lit('{"n":'), n, F.lit("}"))
    text = F.when(slot == 2, F.concat(F.lit(" ```json\n"), whole, F.lit("\n```"))).when(slot == 3, F.concat(whole, F.lit(" done"))).when(slot == 4, F.concat(F.lit("["), n, F.lit("]"))).otherwise(whole)
    s = read(spark, sf_dir, "visible_segments").select("segment_id", text.alias("text"), F.when(slot == 1, "length").when(slot == 5, None).otherwise("stop").alias("stop_reason"))
    return responses.strict_objects(s).select("segment_id", "fault", "object")


@query(
    f"""WITH {MESSAGES_SQL}
SELECT source_id, count(*) AS entries, count(*) FILTER (entry_type = 'message') AS messages, count(*) FILTER (entry_type = 'message' AND role = 'user') AS users, count(*) FILTER (entry_type = 'message' AND role = 'assistant') AS assistants,
  CAST(coalesce(sum({size_sql("text")}) FILTER (entry_type = 'message'), 0) AS BIGINT) AS chars, min(line_index) AS first_line, max(line_index) AS last_line FROM m GROUP BY source_id"""
)
def session_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals per session."""
    m = M.with_message(entries(spark, sf_dir))
    said = F.col("entry_type") == "message"
    return m.groupBy("source_id").agg(
        F.count("*").alias("entries"), F.count_if(said).alias("messages"), F.count_if(said & (F.col("role") == "user")).alias("users"), F.count_if(said & (F.col("role") == "assistant")).alias("assistants"),
        F.sum(F.when(said, T.utf16_length(F.col("text"))).otherwise(0)).alias("chars"), F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"),
    )


@query("SELECT coalesce(store_state, '') AS merge, sha256(string_agg(source_id || ':' || sha256(source_path), chr(10) ORDER BY source_id || ':' || sha256(source_path))) AS input_hash FROM sessions GROUP BY ALL")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the sessions of each state of storage."""
    s = read(spark, sf_dir, "sessions").select(F.coalesce("store_state", F.lit("")).alias("merge"), "source_id", F.sha2("source_path", 256).alias("sha256"))
    return session_build.input_hash(s, "merge")


@query(
    """SELECT source_id, coalesce(CASE WHEN regexp_full_match(created_text, '\\d+') THEN CAST(created_text AS BIGINT) ELSE epoch_ms(TRY_CAST(created_text AS TIMESTAMPTZ)) END, created_ms, 0) AS ms FROM sessions"""
)
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each session began, by its text as written, else by its number."""
    s = read(spark, sf_dir, "sessions")
    written = F.when(F.col("created_text").rlike("^[0-9]+$"), F.col("created_text")).otherwise(F.to_json(F.array("created_text")))
    plain = F.when(written.startswith("["), F.regexp_replace(written, r"^\[|\]$", "")).otherwise(written)
    return s.select("source_id", session_build.session_time(F.when(F.col("created_text").isNotNull(), plain), F.col("created_ms").cast("string")).alias("ms"))


REPEATS_SQL = """f AS (SELECT source_id AS ledger_id, 'f' || (segment_id % 50) AS fact_id, 'd' AS domain, 's' || (segment_id % 3) AS subject, CASE WHEN segment_id % 2 = 0 THEN 'state' ELSE 'fix' END AS category,
  CASE WHEN segment_id % 5 = 0 THEN 'current' ELSE 'historical' END AS status, CASE WHEN segment_id % 4 = 0 THEN ' SAID ' ELSE 'Said ' END || (segment_id % 40) AS statement FROM visible_segments WHERE source_id IS NOT NULL)"""


@query(
    f"""WITH {REPEATS_SQL}, v AS (
  SELECT ledger_id, fact_id, 'repeated id' AS violation, count(*) OVER (PARTITION BY ledger_id, fact_id) AS n FROM f
  UNION ALL SELECT ledger_id, fact_id, 'repeated statement', count(*) OVER (PARTITION BY ledger_id, domain, subject, lower(trim(statement))) FROM f
  UNION ALL SELECT ledger_id, fact_id, 'two current states', count(*) OVER (PARTITION BY ledger_id, domain, subject) FROM f WHERE category = 'state' AND status = 'current')
SELECT DISTINCT ledger_id, fact_id, violation FROM v WHERE n > 1"""
)
def ledger_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What planted ledgers hold twice that must be there once."""
    n = F.col("segment_id")
    part = lambda head, k: F.concat(F.lit(head), (n % k).cast("string"))
    facts = read(spark, sf_dir, "visible_segments").filter("source_id is not null").select(
        F.col("source_id").alias("ledger_id"), part("f", 50).alias("fact_id"), F.lit("d").alias("domain"), part("s", 3).alias("subject"), F.when(n % 2 == 0, "state").otherwise("fix").alias("category"),
        F.when(n % 5 == 0, "current").otherwise("historical").alias("status"), F.concat(F.when(n % 4 == 0, " SAID ").otherwise("Said "), (n % 40).cast("string")).alias("statement"),
    )
    return ledger.repeated(facts)


PLACED_SQL = "p AS (SELECT source_id AS ledger_id, row_number() OVER (PARTITION BY source_id ORDER BY segment_id) - 1 AS n, count(*) OVER (PARTITION BY source_id) AS many FROM visible_segments WHERE source_id IS NOT NULL)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each source by number, from 0: ``ledger_id``, ``n``, ``many``."""
    s = read(spark, sf_dir, "visible_segments").filter("source_id is not null").select(F.col("source_id").alias("ledger_id"), "segment_id")
    rows = ordering.position_in_group(s, "ledger_id", [F.col("segment_id")], "n").select("ledger_id", (F.col("n") - 1).alias("n"))
    return rows.join(rows.groupBy("ledger_id").agg(F.count("*").alias("many")), "ledger_id")


@query(
    f"""WITH {PLACED_SQL}
SELECT ledger_id, 'f' || n AS fact_id, CASE n % 5 WHEN 0 THEN 'no such target' WHEN 1 THEN 'no such target' ELSE 'wrong target' END AS violation FROM p
WHERE n % 5 IN (0, 1) OR (n % 5 = 2 AND n >= 4) OR (n % 5 = 3 AND n >= 4)"""
)
def ledger_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted supersessions: of the fact itself, of none, of another subject, of a current fact, and sound ones."""
    rows, n = placed(spark, sf_dir), F.col("n")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    facts = rows.select("ledger_id", name(n).alias("fact_id"), F.lit("d").alias("domain"), F.when(n % 5 == 3, "other").otherwise("s").alias("subject"), F.when(n % 5 == 4, "superseded").otherwise("current").alias("status"))
    target = F.when(n % 5 == 0, name(n)).when(n % 5 == 1, "gone").when(n % 5 == 2, name(n - 3 + 1)).when(n % 5 == 3, name(n - 4)).otherwise(name(n - 5))
    links = rows.filter("n >= 4 or n % 5 < 2").select("ledger_id", name(n).alias("fact_id"), target.alias("target_id")).filter("fact_id <> 'f4'")
    return ledger.broken_links(facts, links)


@query(f"WITH {PLACED_SQL} SELECT ledger_id, 'f' || n AS fact_id, 'loop' AS violation FROM p WHERE n // 5 % 3 = 0 AND (n // 5 + 1) * 5 <= many")
def ledger_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted chains of five supersessions, every third chain closed to a loop."""
    rows, n = placed(spark, sf_dir), F.col("n")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    step = F.when(n % 5 < 4, n + 1).when(F.floor(n / 5) % 3 == 0, n - 4)
    links = rows.select("ledger_id", name(n).alias("fact_id"), step.cast("long").alias("to"), "many").filter("to is not null and to < many").select("ledger_id", "fact_id", name(F.col("to")).alias("target_id"))
    return ledger.in_loops(links)


@query(
    """WITH w AS (SELECT DISTINCT source_id AS ledger_id, seg_kind AS source_id FROM visible_segments WHERE source_id IS NOT NULL AND seg_kind IS NOT NULL),
h AS (SELECT source_id AS ledger_id, CASE WHEN segment_id % 9 = 0 THEN 'extra' ELSE seg_kind END AS source_id, count(*) AS n FROM visible_segments WHERE source_id IS NOT NULL AND seg_kind IS NOT NULL AND segment_id % 3 = 0 GROUP BY ALL)
SELECT ledger_id, source_id, 'missing' AS violation FROM w ANTI JOIN h USING (ledger_id, source_id) UNION ALL SELECT ledger_id, source_id, 'extra' FROM h ANTI JOIN w USING (ledger_id, source_id)
UNION ALL SELECT ledger_id, source_id, 'repeated' FROM h WHERE n > 1"""
)
def ledger_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that planted ledgers miss, name besides or name twice."""
    s = read(spark, sf_dir, "visible_segments").filter("source_id is not null and seg_kind is not null")
    covered = s.filter("segment_id % 3 = 0").select(F.col("source_id").alias("ledger_id"), F.when(F.col("segment_id") % 9 == 0, "extra").otherwise(F.col("seg_kind")).alias("source_id"))
    return ledger.uncovered(s.select(F.col("source_id").alias("ledger_id"), F.col("seg_kind").alias("source_id")), covered)


REFS_SQL = "r AS (SELECT DISTINCT segment_id // 3 AS item_id, 'c' || (segment_id % 20) AS ref FROM visible_segments)"


def planted_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References of items to twenty coverage ids, and evidence for half of them."""
    refs = read(spark, sf_dir, "visible_segments").select(F.floor(F.col("segment_id") / 3).cast("long").alias("item_id"), F.concat(F.lit("c"), (F.col("segment_id") % 20).cast("string")).alias("ref"))
    evidence = spark.range(0, 30, 2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("coverage_id"), F.concat(F.lit("EVD-"), F.col("id").cast("string")).alias("evidence_id"))
    return refs, evidence


@query(f"WITH {REFS_SQL} SELECT item_id, CASE WHEN CAST(substr(ref, 2) AS INT) % 2 = 0 THEN 'EVD-' || substr(ref, 2) ELSE ref END AS ref FROM r")
def evidence_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with evidence ids in the place of coverage ids, each once."""
    return ledger.remapped(*planted_refs(spark, sf_dir))


@query(
    f"""WITH {REFS_SQL} SELECT 'used' AS state, NULL AS item_id, 'EVD-' || k AS ref FROM (SELECT DISTINCT CAST(substr(ref, 2) AS INT) AS k FROM r) WHERE k % 2 = 0
UNION ALL SELECT 'dangling', item_id, ref FROM r WHERE CAST(substr(ref, 2) AS INT) % 2 = 1"""
)
def evidence_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that some item refers to, and references without evidence."""
    refs, evidence = planted_refs(spark, sf_dir)
    used, dangling = ledger.referenced(evidence, ledger.remapped(refs, evidence))
    return used.distinct().select(F.lit("used").alias("state"), F.lit(None).cast("long").alias("item_id"), F.col("evidence_id").alias("ref")).unionByName(dangling.distinct().select(F.lit("dangling").alias("state"), "item_id", "ref"))


@query("SELECT segment_id AS item_id FROM visible_segments WHERE segment_id % 5 <> 1 AND segment_id % 5 <> 2")
def phantom_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted texts without those that are nothing but internal ids of which one is unknown."""
    n = F.col("segment_id") % 5
    known, unknown = "DEC-0123456789", "ACT-ffffffffff"
    text = F.when(n == 0, known).when(n == 1, unknown).when(n == 2, f" {known} {unknown} ").when(n == 3, f"see {unknown}").otherwise("plain")
    s = read(spark, sf_dir, "visible_segments").select(F.col("segment_id").alias("item_id"), text.alias("text"))
    return ledger.without_phantoms(s, spark.createDataFrame([(known,)], "id string")).select("item_id")


@query(f"WITH {PLACED_SQL} SELECT DISTINCT ledger_id AS source_id, 2 AS place, t.sub, 't' || (t.sub - 1) AS message FROM p, (VALUES (1), (2)) t(sub) WHERE many >= 5 AND left(ledger_id, 1) >= '8'")
def retained_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put in behind planted summaries: a kept tail of two messages, unless both are there already."""
    rows = placed(spark, sf_dir).withColumnRenamed("ledger_id", "source_id").filter("many >= 5")
    message = lambda n: F.concat(F.lit("m"), n.cast("string"))
    messages = rows.select("source_id", F.col("n").alias("place"), message(F.col("n")).alias("message"))
    there = F.left("source_id", F.lit(1)) < "8"
    tails = rows.filter("n < 2").select("source_id", F.col("n").cast("int").alias("idx"), F.when(there, message(F.col("n") + 3)).otherwise(F.concat(F.lit("t"), F.col("n").cast("string"))).alias("message"))
    summaries = rows.select("source_id").distinct().withColumn("at", F.lit(2))
    return trees.with_retained_tail(messages, tails, summaries).filter("sub > 0").select("source_id", "place", "sub", "message")


@query(
    f"""WITH {PLACED_SQL}, s AS (SELECT *, many > 1 AND NOT (many > 3 AND left(ledger_id, 1) < '8') AS reuse FROM p)
SELECT ledger_id AS source_id, n AS source_order, 'p' || n AS text, false AS reused FROM s WHERE NOT reuse OR n > 1
UNION ALL SELECT ledger_id, n, 's' || n, true FROM s WHERE reuse AND n < 2"""
)
def stored_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a planted stored result at their second entry, followed by a compaction in some: what their documents hold."""
    rows, n = placed(spark, sf_dir).withColumnRenamed("ledger_id", "source_id"), F.col("n")
    kept = '{"schemaVersion":1,"body":"b","outputContentHash":"o","policyHash":"p","segments":[{"kind":"user","text":"s0"},{"kind":"user","text":"s1"}]}'
    compacted = (n == 3) & (F.left("source_id", F.lit(1)) < "8")
    branch = rows.select("source_id", n.alias("place"), F.when(n == 1, "custom").when(compacted, "compaction").otherwise("message").alias("entry_type"), F.when(n == 1, "cleanup_ir").alias("custom_type"), F.when(n == 1, kept).alias("data"))
    said = rows.select("source_id", n.alias("place"), F.lit(0).alias("part"), F.lit("user").alias("seg_kind"), F.concat(F.lit("p"), n.cast("string")).alias("text"), F.lit("verbatim").alias("fidelity"))
    return S.document_segments(branch, said).select("source_id", "source_order", "text", "reused")
