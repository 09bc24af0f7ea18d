import json

from pyspark.sql import functions as F

from loomline.operators import line_archive, trees
from loomline.sources import sessions


def test_merged_trees(spark):
    rows = [("a", 0, "1", None, 0, "message", 1), ("a", 0, "2", "1", 1, "message", 1), ("a", 0, "3", "gone", 2, "message", 1), ("a", 0, "4", "1", 3, "x", 1), ("a", 0, "4", "1", 4, "x", 1), (None, 0, "1", None, 0, "message", 1), ("b", 1, "", None, 0, "message", 1)]
    df = spark.createDataFrame(rows, "source_id string, source_index int, entry_id string, parent_id string, line_index long, entry_type string, new_id int")
    tree = {(r.source_id, r.entry_id, r.line_index): r for r in trees.merged(df).collect()}
    assert len(tree) == 6 and tree["a", None, -1].new_parent_id == trees.ROOT
    assert tree["a", "1", 0].new_parent_id == tree["a", None, -1].new_id and tree["a", "2", 1].new_parent_id == tree["a", "1", 0].new_id
    assert tree["a", "3", 2].fault == "no parent" and tree["a", "3", 2].new_parent_id is None and tree["a", "4", 3].fault == "repeated id"
    assert trees.merge_faults(trees.merged(df), df).count() == 0 and trees.merged(df.limit(0)).count() == 0


def test_retained_tail(spark):
    messages = spark.createDataFrame([("a", k, m) for k, m in enumerate("Sxyz")] + [("b", k, m) for k, m in enumerate("Suv")] + [("c", 0, "m")], "source_id string, place long, message string")
    tails = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "v"), ("c", 0, "t")], "source_id string, idx int, message string")
    summaries = spark.createDataFrame([("a", 0), ("b", 0)], "source_id string, at int")
    got = trees.with_retained_tail(messages, tails, summaries).orderBy("source_id", "place", "sub").collect()
    text = {s: "".join(r.message for r in got if r.source_id == s) for s in "abc"}
    assert text == {"a": "Sxyz", "b": "Sxvuv", "c": "tm"}


def stored(n, kind="user"):
    return json.dumps({"schemaVersion": 1, "body": "b", "outputContentHash": "o", "policyHash": "p", "segments": [{"kind": kind, "text": f"s{k}"} for k in range(n)]})


def test_stored_results_are_reused(spark):
    rows = [
        ("a", 0, "custom", "cleanup_ir", stored(3)), ("a", 1, "custom", "cleanup_ir", stored(2)), ("a", 2, "message", None, None),
        ("b", 0, "custom", "cleanup_ir", stored(2)), ("b", 1, "compaction", None, None),
        ("c", 0, "custom", "cleanup_ir", stored(2, "odd")), ("c", 1, "custom", "cleanup_ir", "{"), ("d", 0, "custom", "cleanup_ir", stored(0)),
    ]
    branch = spark.createDataFrame(rows, "source_id string, place long, entry_type string, custom_type string, data string")
    assert {(r.source_id, r.at) for r in sessions.reusable(branch).collect()} == {("a", 1), ("d", 0)}
    said = spark.createDataFrame([("a", 0, 0, "user", "old", "verbatim"), ("a", 2, 0, "user", "new", "verbatim"), ("b", 3, 1, "user", "x", "verbatim")], "source_id string, place long, part long, seg_kind string, text string, fidelity string")
    got = sorted((r.source_id, r.source_order, r.text, r.reused) for r in sessions.document_segments(branch, said).collect())
    assert got == [("a", 0, "s0", True), ("a", 1, "s1", True), ("a", 2, "new", False), ("b", 3, "x", False)]


def lines(spark, n=13):
    return spark.createDataFrame([("s", k, json.dumps({"type": "message", "id": str(k), "parentId": None, "timestamp": 100 - k})) for k in range(n)] + [("t", 0, "")], "source_id string, line_index long, raw string")


def test_archive_of_lines(spark):
    raw = lines(spark)
    made = line_archive.chunks(raw, 5).cache()
    assert [r.n for r in made.groupBy("source_id").agg(F.count("*").alias("n")).orderBy("source_id").collect()] == [3, 1]
    sources, records = line_archive.manifest(made).cache(), line_archive.timeline(raw).cache()
    assert line_archive.faults(made, sources, records, 5).count() == 0
    back = line_archive.restored_lines(made).select("source_id", "chunk_index", F.posexplode("raw_lines").alias("k", "raw")).select("source_id", (F.col("chunk_index") * 5 + F.col("k")).alias("line_index"), "raw")
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    name = line_archive.archive_id(sources).first()[0]
    assert name.startswith("hist-") and len(name) == 29 and name == line_archive.archive_id(sources.repartition(3)).first()[0]
    assert name != line_archive.archive_id(sources.withColumn("bytes", F.col("bytes") + 1)).first()[0]


def test_archive_faults(spark):
    raw = lines(spark)
    made, records = line_archive.chunks(raw, 5), line_archive.timeline(raw)
    sources = line_archive.manifest(made)

    def found(a=made, s=sources, r=records):
        return {tuple(x) for x in line_archive.faults(a, s, r, 5).collect()}

    assert found(made.filter("chunk_index <> 1")) == {("s", "chunk missing")} and found(made.unionByName(made.limit(1)))
    assert found(made.withColumn("data", F.when(F.col("chunk_index") == 2, "AAAA").otherwise(F.col("data")))) == {("s", "chunk damaged")}
    assert found(s=sources.withColumn("line_count", F.lit(1))) == {("s", "line count")}
    assert found(r=records.withColumn("raw_line_sha256", F.when(F.col("line_index") == 7, "x").otherwise(F.col("raw_line_sha256")))) == {("s", "line hash")}
    placed = records.filter("source_id = 's'").withColumn("position", 13 - F.col("line_index"))
    assert found(r=placed) == set() and found(r=placed.withColumn("position", F.col("line_index"))) == {("s", "order")}


def test_embedded_archives_and_chains(spark):
    rows = [("a", "custom", "cleanup_history_manifest", "1"), ("b", "custom", "cleanup_history_manifest", "1"), ("b", "custom", "cleanup_history_manifest", "2"), ("c", "message", None, None)]
    one, many = line_archive.embedded(spark.createDataFrame(rows, "source_id string, entry_type string, custom_type string, data string"))
    assert [tuple(r) for r in one.collect()] == [("a", "1")] and [tuple(r) for r in many.collect()] == [("b", "several manifests")]
    chain = line_archive.chained(spark.createDataFrame([(k, "t", "d") for k in range(3)], "place int, custom_type string, data string"), "top", "leaf").orderBy("place").collect()
    assert chain[0].parent_id == "top" and chain[1].parent_id == chain[0].entry_id and chain[2].parent_id == chain[1].entry_id and chain[2].entry_id == "leaf"
