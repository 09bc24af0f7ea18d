import json

from pyspark.sql import functions as F

from loomline.operators import records, session_build

COLUMNS = "source_id string, entry_id string, parent_id string, line_index long, entry_type string, message string, summary string"


def say(k, role, text, **more):
    return ("s", str(k), None, k, "message", json.dumps({"role": role, "content": [{"type": "text", "text": text}], **more}, ensure_ascii=False), None)


def rows():
    return [
        say(1, "user", "Please fix the login page now", timestamp=1_700_000_000_000), say(2, "toolResult", "3 tests passed, file updated", toolName="bash", isError=False), say(3, "assistant", "The root cause was found and the tests passed.", timestamp="2025-01-01T00:00:00Z"),
        say(4, "user", "Then write the release notes for it"), say(5, "toolResult", "error: no such file", toolName="write", isError=True), ("s", "9", None, 9, "compaction", None, " what came before "),
    ]


def test_records_are_rendered(spark):
    df = spark.createDataFrame(rows(), COLUMNS)
    got = {r.turn_index: r for r in records.rendered(df).collect()}
    first, second = got[1], got[2]
    assert first.mode == "assistant_final" and first.text == (
        "[result_record turn=1 mode=assistant_final] time=2025-01-01T00:00:00Z\n\n" + records.USER_LABEL + "Please fix the login page now\n\n" + records.FINAL_LABEL + "The root cause was found and the tests passed."
    )
    assert first.selected_units == len(records.USER_LABEL + "Please fix the login page now") + len("The root cause was found and the tests passed.")
    assert second.mode == "evidence_fallback" and second.text.endswith("[Tool evidence · write · ERROR]\nerror: no such file") and "time=" not in second.text
    blocks = records.with_summary(records.rendered(df), df)
    assert [r.text for r in blocks.filter("turn_index = -1").collect()] == [" what came before "]
    (stats,) = records.size_stats(blocks, df).collect()
    assert stats.raw_units == sum(len(r[5]) for r in rows() if r[5]) and stats.selected_units == sum(len(r.text) for r in blocks.collect())
    assert records.rendered(df.limit(0)).count() == 0


def test_built_sessions(spark):
    s = spark.createDataFrame([("s", 1, "user", "b", "verbatim"), ("s", 0, "tool", "a\"", "verbatim"), (None, 0, "user", "x", "derived")], "source_id string, source_order long, seg_kind string, text string, fidelity string")
    made = session_build.built(session_build.stored_results(s, "p"), F.struct(F.lit(3).alias("schemaVersion")))
    assert session_build.build_faults(made).count() == 0 and made.count() == 8
    lines = [json.loads(r.raw) for r in made.filter("source_id = 's'").orderBy("line_index").collect()]
    assert lines[0] == {"type": "session", "id": "s", "version": 3} and lines[1]["content"] == [{"type": "text", "text": "a\"\n\nb"}]
    assert [x["text"] for x in lines[2]["data"]["segments"]] == ["a\"", "b"] and lines[3] == {"type": "custom", "id": lines[3]["id"], "parentId": lines[2]["id"], "customType": "cleanup_manifest", "data": {"schemaVersion": 3}}
    assert {r.fault for r in session_build.build_faults(made.filter("line_index <> 2")).collect()} == {"cleanup_ir not once", "broken chain"}


def test_titles(spark):
    (got,) = spark.range(1).select(session_build.title(F.array(*map(F.lit, "abcde"))), session_build.title(F.array(F.lit("a")))).collect()
    assert tuple(got) == ("a, b, c +2", "a")
