"""Registered queries of the core, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.hierarchy import descendants, expand_paths, hierarchy
from loomline.operators import schema_drift
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


TREE_SQL = """
WITH RECURSIVE e AS (
  SELECT source_id, entry_id, nullif(max_by(coalesce(parent_id, ''), struct_pack(l := line_index, p := coalesce(parent_id, ''))), '') AS parent_id
  FROM timeline_records WHERE entry_id IS NOT NULL AND entry_id <> '' GROUP BY ALL),
n AS (SELECT e.source_id, e.entry_id, p.entry_id AS parent_id FROM e LEFT JOIN e p ON e.source_id = p.source_id AND e.parent_id = p.entry_id),
walk AS (
  SELECT source_id, entry_id, entry_id AS root_id, CAST(0 AS BIGINT) AS node_depth FROM n WHERE parent_id IS NULL
  UNION ALL
  SELECT n.source_id, n.entry_id, w.root_id, w.node_depth + 1 FROM walk w JOIN n ON n.source_id = w.source_id AND n.parent_id = w.entry_id),
lost AS (SELECT * FROM n ANTI JOIN walk USING (source_id, entry_id)),
steps AS (
  SELECT source_id, entry_id AS start_id, entry_id, parent_id, [entry_id] AS seen FROM lost
  UNION ALL
  SELECT s.source_id, s.start_id, l.entry_id, l.parent_id, list_append(s.seen, l.entry_id)
  FROM steps s JOIN lost l ON l.source_id = s.source_id AND l.entry_id = s.parent_id WHERE NOT list_contains(s.seen, l.entry_id)),
loops AS (
  SELECT source_id, start_id AS entry_id, list_min(seen[list_position(seen, parent_id):]) AS root_id
  FROM steps WHERE list_contains(seen, parent_id)),
found AS (SELECT source_id, entry_id, root_id, node_depth FROM walk UNION ALL SELECT source_id, entry_id, root_id, CAST(-1 AS BIGINT) FROM loops)
"""


@query(TREE_SQL + "SELECT * FROM found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every timeline entry, through its heavy-path chains."""
    return hierarchy(read(spark, sf_dir, "timeline_records"), with_path=False).select("source_id", "entry_id", "root_id", "node_depth")


HEAVY_SQL = (
    TREE_SQL
    + """, anc AS (SELECT source_id, entry_id, parent_id AS up FROM n JOIN walk USING (source_id, entry_id) WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.source_id, a.entry_id, n.parent_id FROM anc a JOIN n ON n.source_id = a.source_id AND n.entry_id = a.up WHERE n.parent_id IS NOT NULL),
sized AS (SELECT w.source_id, w.entry_id, n.parent_id, w.root_id, w.node_depth, 1 + coalesce(c.size, 0) AS size FROM walk w JOIN n USING (source_id, entry_id)
  LEFT JOIN (SELECT source_id, up, count(*) AS size FROM anc GROUP BY ALL) c ON c.source_id = w.source_id AND c.up = w.entry_id),
kids AS (SELECT *, row_number() OVER o = 1 AS heavy, 1 + coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step
  FROM sized WHERE parent_id IS NOT NULL WINDOW o AS (PARTITION BY source_id, parent_id ORDER BY size DESC, entry_id)),
placed AS (
  SELECT source_id, entry_id, entry_id AS chain_id, CAST(0 AS BIGINT) AS chain_pos, CAST(0 AS HUGEINT) AS pre_order, '' AS above FROM sized WHERE parent_id IS NULL
  UNION ALL
  SELECT k.source_id, k.entry_id, CASE WHEN heavy THEN p.chain_id ELSE k.entry_id END, CASE WHEN heavy THEN p.chain_pos + 1 ELSE 0 END, p.pre_order + k.step,
    CASE WHEN heavy THEN p.above ELSE p.above || p.chain_id || ':' || p.chain_pos || '/' END
  FROM placed p JOIN kids k ON k.source_id = p.source_id AND k.parent_id = p.entry_id)
"""
)


@query(
    HEAVY_SQL
    + """SELECT source_id, entry_id, parent_id, root_id, node_depth, chain_id, chain_pos, size AS subtree_size, CAST(pre_order AS BIGINT) AS pre_order, above || chain_id || ':' || chain_pos AS path FROM sized JOIN placed USING (source_id, entry_id)
UNION ALL SELECT source_id, entry_id, n.parent_id, loops.root_id, -1, NULL, NULL, NULL, NULL, NULL FROM loops JOIN n USING (source_id, entry_id)"""
)
def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with chain, subtree size, pre-order number and its path as chain segments (``chain:last position`` joined by ``/``)."""
    named = F.transform("path", lambda s: F.concat_ws(":", s["chain_id"], s["upto"].cast("string")))
    return hierarchy(read(spark, sf_dir, "timeline_records")).withColumn("path", F.array_join(named, "/"))


# The stated query set of both: entries whose line is divisible by 100, against all entries.
ASKED_SQL = "SELECT source_id, entry_id FROM (SELECT source_id, entry_id, max(line_index) AS line FROM timeline_records WHERE entry_id <> '' GROUP BY ALL) WHERE line % 100 = 0"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries whose line is divisible by 100."""
    lines = read(spark, sf_dir, "timeline_records").filter("entry_id <> ''").groupBy("source_id", "entry_id").agg(F.max("line_index").alias("line"))
    return lines.filter("line % 100 = 0").select("source_id", "entry_id")


@query(
    TREE_SQL
    + f""", top AS (SELECT w.source_id, w.entry_id FROM walk w SEMI JOIN ({ASKED_SQL}) USING (source_id, entry_id)),
down AS (SELECT source_id, entry_id, entry_id AS descendant_id FROM top UNION ALL SELECT d.source_id, d.entry_id, n.entry_id FROM down d JOIN n ON n.source_id = d.source_id AND n.parent_id = d.descendant_id)
SELECT * FROM down WHERE entry_id <> descendant_id"""
)
def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every hundredth line of each source."""
    return descendants(hierarchy(read(spark, sf_dir, "timeline_records")), asked(spark, sf_dir))


@query(
    TREE_SQL
    + f""", up AS (SELECT w.source_id, w.entry_id, w.entry_id AS ancestor_id, w.node_depth AS step FROM walk w SEMI JOIN ({ASKED_SQL}) USING (source_id, entry_id)
  UNION ALL SELECT u.source_id, u.entry_id, n.parent_id, u.step - 1 FROM up u JOIN n ON n.source_id = u.source_id AND n.entry_id = u.ancestor_id WHERE n.parent_id IS NOT NULL)
SELECT * FROM up"""
)
def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of every hundredth line of each source, one row per step."""
    return expand_paths(hierarchy(read(spark, sf_dir, "timeline_records")), asked(spark, sf_dir))


@query(TREE_SQL + "SELECT source_id, root_id AS loop_id, count(*) AS entries FROM found WHERE node_depth = -1 GROUP BY ALL")
def p4_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loops of each source and the entries on or below each."""
    tree = hierarchy(read(spark, sf_dir, "timeline_records"), with_path=False)
    return tree.filter("node_depth = -1").groupBy("source_id", F.col("root_id").alias("loop_id")).agg(F.count("*").alias("entries"))


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of fields between a file and the file before it."""
    return schema_drift.drift(read(spark, sf_dir, "raw_records"))


@query()
def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered log of changes of every stream."""
    return schema_drift.changes(read(spark, sf_dir, "raw_records"))


FIELDS_SQL = """
WITH RECURSIVE r AS (SELECT stream_id, file_seq, file_name, record_kind, CAST(raw_text AS JSON) AS j FROM raw_records WHERE file_name IS NOT NULL AND json_valid(raw_text) AND json_type(raw_text) = 'OBJECT'),
k AS (
  SELECT stream_id, file_seq, file_name, record_kind, name AS field, json_extract(j, '$."' || name || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS name FROM r)
  UNION ALL
  SELECT stream_id, file_seq, file_name, record_kind, below || name, json_extract(o, '$."' || name || '"') FROM (
    SELECT *, unnest(json_keys(o)) AS name FROM (
      SELECT stream_id, file_seq, file_name, record_kind, field || CASE json_type(v) WHEN 'ARRAY' THEN '[].' ELSE '.' END AS below,
        unnest(CASE json_type(v) WHEN 'OBJECT' THEN [v] ELSE list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT') END) AS o
      FROM k WHERE json_type(v) IN ('OBJECT', 'ARRAY')))),
leaf AS (SELECT stream_id, file_seq, file_name, record_kind, field, json_type(v) = 'DOUBLE' AS wide,
    CASE json_type(v) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type FROM k
  WHERE json_type(v) NOT IN ('NULL', 'OBJECT') AND NOT (json_type(v) = 'ARRAY' AND len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT')) > 0)),
file AS (SELECT stream_id, file_seq, file_name, field, max(record_kind) AS record_kind, CASE WHEN bool_or(type = 'string') OR (bool_or(type = 'array') AND count(DISTINCT type) > 1) THEN 'string'
    WHEN bool_or(type = 'array') THEN 'array' WHEN bool_or(type = 'number') THEN 'number' ELSE 'boolean' END AS type, bool_or(wide) AS wide FROM leaf GROUP BY stream_id, file_seq, file_name, field),
held AS (SELECT DISTINCT stream_id, file_seq, file_name, split_part(field, '[]', 1) AS field FROM file WHERE contains(field, '[]')),
kept AS (SELECT f.* FROM file f LEFT JOIN held h ON f.stream_id IS NOT DISTINCT FROM h.stream_id AND f.file_seq IS NOT DISTINCT FROM h.file_seq AND f.file_name = h.file_name AND f.field = h.field
  WHERE NOT (f.type = 'array' AND h.field IS NOT NULL))
"""


@query(
    FIELDS_SQL
    + """SELECT record_kind, field, CASE WHEN bool_or(type = 'string') OR (bool_or(type = 'array') AND count(DISTINCT type) > 1) THEN 'string' WHEN bool_or(type = 'array') THEN 'array'
  WHEN bool_or(type = 'number') THEN CASE WHEN bool_or(wide) THEN 'double' ELSE 'long' END ELSE 'boolean' END AS type, count(*) AS files, count(DISTINCT type) AS types FROM kept GROUP BY record_kind, field"""
)
def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union schema of each record kind."""
    return schema_drift.fields(read(spark, sf_dir, "raw_records"))


@query()
def p2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All session headers as one table."""
    return schema_drift.unified(read(spark, sf_dir, "raw_records"), "header")


@query()
def p2_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleanup manifests as one table."""
    return schema_drift.unified(read(spark, sf_dir, "raw_records"), "manifest")
