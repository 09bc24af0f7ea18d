"""Registered queries on text, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import conversations, leakage, mixing, near_duplicates, pii, reading
from loomline.runtime import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of personal information in messages and summaries."""
    return pii.found(read(spark, sf_dir, "session_entries"), read(spark, sf_dir, "name_parts"))


@query()
def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of messages and summaries, with typed placeholders, by its place."""
    return pii.redacted(read(spark, sf_dir, "session_entries"), read(spark, sf_dir, "name_parts"))


@query()
def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries with messages and summaries free of personal information."""
    return pii.cleaned(read(spark, sf_dir, "session_entries"), read(spark, sf_dir, "name_parts"))


TALK_SQL = r"""
WITH RECURSIVE e AS (
  SELECT source_id, entry_id, max_by(coalesce(parent_id, ''), line_index) AS parent_id, max(line_index) AS line_index, max_by(entry_type, line_index) AS entry_type,
    max_by(struct_pack(v := message), line_index).v AS message FROM session_entries GROUP BY source_id, entry_id),
r AS (SELECT *, CASE WHEN json_valid(message) AND json_type(message) = 'OBJECT' THEN lower(trim(coalesce(message->>'$.role', ''))) END AS role,
             CASE WHEN json_valid(message) THEN json_type(message, '$.content') END AS shape FROM e),
k AS (SELECT *, CASE WHEN entry_type <> 'message' THEN 0
    WHEN role IS NULL OR role NOT IN ('user','human','assistant','ai','bot','model','toolresult','tool_result','tool','bashexecution','branchsummary','compactionsummary','custom','system') THEN 9
    WHEN role NOT IN ('user','human','assistant','ai','bot','model') THEN 3
    WHEN CASE shape WHEN 'VARCHAR' THEN NOT regexp_full_match(message->>'$.content', '[\s\pZ]*')
              WHEN 'ARRAY' THEN len(list_filter(json_extract(message, '$.content[*]'), lambda b: (b->>'$.type') = 'text' AND NOT regexp_full_match(coalesce(b->>'$.text', ''), '[\s\pZ]*'))) > 0
              ELSE false END
    THEN CASE WHEN role IN ('user','human') THEN 1 ELSE 2 END ELSE 3 END AS kind FROM r),
walk AS (
  SELECT source_id, entry_id, entry_id AS root_id, line_index, 0 AS depth FROM k WHERE parent_id = ''
  UNION ALL SELECT k.source_id, k.entry_id, w.root_id, k.line_index, w.depth + 1 FROM walk w JOIN k ON k.source_id = w.source_id AND k.parent_id = w.entry_id),
tip AS (SELECT source_id, root_id, max_by(entry_id, line_index) AS entry_id FROM walk GROUP BY ALL),
path AS (
  SELECT source_id, root_id, entry_id FROM tip
  UNION ALL SELECT p.source_id, p.root_id, k.parent_id FROM path p JOIN k USING (source_id, entry_id) WHERE k.parent_id <> ''),
full_path AS (SELECT p.source_id, p.root_id, entry_id, k.kind, w.depth FROM path p JOIN k USING (source_id, entry_id) JOIN walk w USING (source_id, entry_id)),
turns AS (SELECT source_id, root_id, entry_id, kind, row_number() OVER w AS turn_no, lead(kind) OVER w AS next_kind
  FROM full_path WHERE kind IN (1, 2) WINDOW w AS (PARTITION BY source_id, root_id ORDER BY depth)),
bad AS (SELECT source_id, root_id FROM full_path WHERE kind = 9
  UNION SELECT source_id, root_id FROM turns WHERE (turn_no = 1 AND kind = 2) OR (kind = 1 AND coalesce(next_kind, 0) <> 2)),
kept AS (SELECT source_id, root_id, turn_no, entry_id, kind FROM turns ANTI JOIN bad USING (source_id, root_id))
"""


@query(TALK_SQL + "SELECT source_id, root_id, turn_no, entry_id FROM kept")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered turns of every kept conversation, along the parents that entries name: its definition knows no other links, so none are scored (``p5_threads`` scores them)."""
    return conversations.kept(read(spark, sf_dir, "session_entries"))


# The likeliest parents in SQL: the same candidates, features and weights, over all entries that name a parent.
LINK_SQL = r"""
WITH e AS (
  SELECT source_id, entry_id, max_by(coalesce(parent_id, ''), line_index) AS parent_id, max(line_index) AS line, max_by(struct_pack(v := ts_ms), line_index).v AS ts,
    max_by(struct_pack(v := message), line_index).v AS message, max_by(entry_type, line_index) AS entry_type FROM session_entries GROUP BY source_id, entry_id),
j AS (SELECT *, CASE WHEN entry_type = 'message' AND json_valid(message) AND json_type(message) = 'OBJECT' THEN message END AS js FROM e),
x AS (SELECT *, CASE json_type(js, '$.content') WHEN 'VARCHAR' THEN js->>'$.content'
  WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(js, '$.content[*]'),
    lambda b: CASE WHEN json_type(b) = 'VARCHAR' THEN b->>'$' WHEN (b->>'$.type') = 'text' THEN b->>'$.text' END), lambda t: t IS NOT NULL), chr(10)) ELSE '' END AS text FROM j),
f AS (SELECT source_id, entry_id, parent_id, line, ts, list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[_.][\p{L}\p{N}_]+)+|[\p{L}\p{N}_]+\(\)|[a-z]+[A-Z][\p{L}\p{N}_]+|\b\d{3,}\b')) AS mentions,
  list_distinct(regexp_extract_all(lower(text), '\p{L}{3,}')) AS words FROM x),
told AS (SELECT source_id, entry_id, parent_id, line, unnest(mentions) AS mention FROM f),
cand AS (
  SELECT source_id, entry_id, lag(entry_id) OVER (PARTITION BY source_id ORDER BY line, entry_id) AS cand FROM f
  UNION SELECT source_id, entry_id, lag(entry_id) OVER (PARTITION BY source_id, mention ORDER BY line, entry_id) FROM told
  UNION SELECT c.source_id, c.entry_id, p.entry_id FROM f c JOIN f p ON p.source_id = c.source_id AND p.entry_id = c.parent_id),
scored AS (
  SELECT c.source_id, c.entry_id, c.parent_id, p.entry_id AS cand, p.line, round(CASE WHEN c.parent_id = p.entry_id THEN 2.0 ELSE 0.0 END
    + 0.5 * CASE WHEN c.ts - p.ts IS NULL THEN 0.0 ELSE exp(-greatest(c.ts - p.ts, 0) / 600000.0) END + 0.3 * least(1.0, len(list_intersect(c.mentions, p.mentions)) / 3.0)
    + 0.2 * CASE WHEN len(c.words) + len(p.words) = 0 THEN 0.0 ELSE len(list_intersect(c.words, p.words)) / (len(c.words) + len(p.words) - len(list_intersect(c.words, p.words))) END, 6) AS score
  FROM cand k JOIN f c ON c.source_id = k.source_id AND c.entry_id = k.entry_id JOIN f p ON p.source_id = k.source_id AND p.entry_id = k.cand WHERE c.parent_id <> ''),
links AS (SELECT source_id, entry_id, parent_id, max(struct_pack(s := score, l := line, c := cand)).c AS likely_parent_id, max(struct_pack(s := score, l := line, c := cand)).s AS score FROM scored GROUP BY source_id, entry_id, parent_id)
"""
#: The conversations of ``TALK_SQL`` with likely parents of a least score in place of lost ones.
THREAD_SQL = TALK_SQL.replace(
    "r AS (SELECT",
    """ee AS (SELECT e.* REPLACE (CASE WHEN e.parent_id = '' THEN '' ELSE coalesce(l.likely_parent_id, e.parent_id) END AS parent_id) FROM e LEFT JOIN likely l ON l.source_id = e.source_id AND l.entry_id = e.entry_id),
r AS (SELECT""",
    1,
).replace("END AS shape FROM e)", "END AS shape FROM ee)")


@query(THREAD_SQL.replace("WITH RECURSIVE e AS", "WITH RECURSIVE likely AS (" + LINK_SQL.strip() + "\nSELECT * FROM links WHERE score >= 0.3),\ne AS", 1) + "SELECT source_id, root_id, turn_no, entry_id FROM kept")
def p5_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations kept when lost parents are replaced by likely ones of a score of 0.3 or more."""
    return conversations.kept(read(spark, sf_dir, "session_entries"), least=0.3)


@query(LINK_SQL + "SELECT source_id, entry_id, likely_parent_id, score FROM links WHERE score < 2")
def p5_likely_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest reply link of each entry whose parent line was lost."""
    return conversations.likely_parents(read(spark, sf_dir, "session_entries"))


@query(LINK_SQL + "SELECT * FROM links")
def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest reply link of every entry that names a parent, with its score."""
    return conversations.links(read(spark, sf_dir, "session_entries"))


LEAK_SQL = r"""
WITH t AS (
  SELECT DISTINCT doc_id, v.w FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
    UNION ALL SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^<>\n]{1,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};', ' ', 'g')), '[\p{L}\p{N}]+') FROM documents) v),
d AS (SELECT doc_id, array_to_string(w[k : k + 14], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM t)),
i AS (SELECT item_id, array_to_string(w[k : k + 14], ' ') AS run FROM (
  SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items))),
hits AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run))
"""


@query(LEAK_SQL + "SELECT doc_id, item_id FROM hits")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold 15 consecutive words of a test item."""
    return leakage.leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


@query(LEAK_SQL + "SELECT item_id, task, CASE WHEN len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 15 THEN coalesce(n, 0) END AS leaking_docs FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM hits GROUP BY ALL) USING (item_id)")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that leak it."""
    return leakage.leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


@query(
    LEAK_SQL
    + r""", parts AS (SELECT item_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n, len(regexp_extract_all(lower(split_part(text, chr(10) || 'Answer:', 1)), '[\p{L}\p{N}]+')) AS q, contains(text, chr(10) || 'Answer:') AS has FROM eval_items),
placed AS (SELECT item_id, k, array_to_string(w[k : k + 14], ' ') AS run FROM (
  SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items))),
covered AS (SELECT DISTINCT doc_id, item_id, unnest(range(k, k + 15)) AS place FROM d JOIN placed USING (run))
SELECT doc_id, item_id, count(*) FILTER (place <= q) AS question_words, count(*) FILTER (has AND place > q + 1) AS answer_words, count(*) = any_value(n) AS whole FROM covered JOIN parts USING (item_id) GROUP BY ALL"""
)
def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of question and answer each leaking document holds in runs of 15 words."""
    return leakage.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


@query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mixing plan with their copies."""
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached token shares of every plan."""
    return mixing.shares(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


@query(
    """WITH t AS (SELECT plan_id, regexp_replace(lower(trim(source)), '[- ]+', '_', 'g') AS source, sum(target_share) AS share FROM mix_targets
  WHERE plan_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 GROUP BY ALL),
d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[- ]+', '_', 'g') AS source FROM documents WHERE text <> '')
SELECT plan_id, source, round(share / sum(share) OVER (PARTITION BY plan_id), 6) AS wanted_share, true AS cap_kept, true AS goal_met, source IN (SELECT source FROM d WHERE source IS NOT NULL) AS has_documents FROM t"""
)
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target whether its cap was kept and its goal met to one percent, as must be."""
    return mixing.checks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents of level 4 or 5."""
    return reading.demanding(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_grades"))


@query()
def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the reading levels with grades they were not fitted to."""
    return reading.agreement(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_grades"))


@query()
def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents by source and reading level."""
    return reading.profile(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_grades"))


NEAR_SQL = r"""
WITH RECURSIVE s AS (SELECT segment_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM visible_segments WHERE length(text) >= 80),
c AS (SELECT segment_id, word, count(*) AS n FROM (SELECT segment_id, unnest(w) AS word FROM s) GROUP BY ALL),
p AS (SELECT a.segment_id AS x, b.segment_id AS y, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.word = b.word AND a.segment_id < b.segment_id GROUP BY ALL),
near AS (SELECT x, y FROM p JOIN s a ON a.segment_id = x JOIN s b ON b.segment_id = y WHERE 5 * shared >= 4 * greatest(len(a.w), len(b.w))),
ends AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT x, x AS y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON e.x = r.y),
class AS (SELECT segment_id, min(segment_id) OVER v AS class_id, count(*) OVER v AS copies FROM s WHERE len(w) > 0 WINDOW v AS (PARTITION BY list_sort(w)))
"""


@query(NEAR_SQL + "SELECT x AS segment_id_a, y AS segment_id_b FROM near")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of segments of which one is a slightly edited copy of the other."""
    return near_duplicates.pairs(read(spark, sf_dir, "visible_segments"))


@query(
    NEAR_SQL
    + """SELECT segment_id, class_id, copies, (SELECT count(*) FROM ends WHERE x = segment_id) AS links,
  coalesce((SELECT min(y) FROM reach WHERE x = segment_id), class_id) AS group_id FROM class"""
)
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every compared segment with its class of copies, its number of links and its group."""
    return near_duplicates.grouped(read(spark, sf_dir, "visible_segments"))
