"""Cases whose results are known from outside: what selection keeps of a turn, the order of a merged timeline, tampering, vocabularies."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import archive, line_archive, ordering, turns, vocabulary

COLUMNS = "source_id string, entry_id string, parent_id string, line_index long, entry_type string, message string, summary string"


def say(k, role, text, **more):
    return ("s", str(k), None, k, "message", json.dumps({"role": role, "content": [{"type": "text", "text": text}]} | more, ensure_ascii=False), None)


@pytest.mark.parametrize(
    "messages,mode,users",
    [
        ([("user", "Move the index over, never touch the old table, and say so if you can't."), ("assistant", "The move finished and the old table is as it was.")], "assistant_final", 1),
        ([("user", "Look at the state without changing any setting."), ("assistant", "Current state is blocked by missing rights; nothing was changed."), ("toolResult", "permission denied")], "evidence_fallback", 1),
        ([("user", "继续"), ("assistant", "The next check passed.")], "assistant_final", 0),
    ],
)
def test_what_is_kept_of_a_turn(spark, messages, mode, users):
    rows = [say(k, role, text, **({"toolName": "diagnostic", "isError": True} if role == "toolResult" else {})) for k, (role, text) in enumerate(messages)]
    (record,) = turns.turn_records(spark.createDataFrame(rows, COLUMNS)).collect()
    assert record.mode == mode and len(record.user_ids) == users


LINES = [
    ("source-a", 0, {"type": "session", "id": "source-a", "timestamp": "2026-01-01T00:00:03Z"}), ("source-a", 0, {"type": "message", "id": "a1", "parentId": None, "timestamp": "2026-01-01T00:00:04Z"}),
    ("source-a", 0, {"type": "message", "id": "a2", "parentId": "a1", "timestamp": "2026-01-01T00:00:06Z"}), ("source-a", 0, {"type": "message", "id": "a-branch", "parentId": "a1", "timestamp": "2026-01-01T00:00:05Z"}),
    ("source-b", 1, {"type": "session", "id": "source-b", "timestamp": "2026-01-01T00:00:01Z"}), ("source-b", 1, {"type": "message", "id": "b1", "parentId": None, "timestamp": "2026-01-01T00:00:02Z"}),
]


def lines(spark):
    place = {}
    rows = []
    for s, index, body in LINES:
        place[s] = place.get(s, -1) + 1
        rows.append((s, index, place[s], json.dumps(body)))
    return spark.createDataFrame(rows, "source_id string, source_index int, line_index long, raw string")


def test_order_of_a_merged_timeline(spark):
    raw = lines(spark)
    t = line_archive.timeline(raw).join(raw.select("source_id", "line_index", "source_index"), ["source_id", "line_index"])
    placed = ordering.global_position(t, [F.col("ts_ms").asc_nulls_last(), F.col("source_index"), F.col("line_index")])
    assert [r.entry_id for r in placed.orderBy("position").collect()] == ["source-b", "b1", "source-a", "a1", "a-branch", "a2"]
    chunks = line_archive.chunks(raw.drop("source_index"))
    assert line_archive.faults(chunks, line_archive.manifest(chunks), placed).count() == 0


def test_one_changed_sign_is_found(spark):
    df = spark.createDataFrame([("a", "first text"), ("b", "second text")], "id string, text string")
    rows = archive.archived(df, "id", "text", chunk_chars=16).collect()
    first = rows[0].data
    spoiled = [r.asDict() | ({"data": ("A" if first[0] != "A" else "B") + first[1:]} if k == 0 else {}) for k, r in enumerate(rows)]
    base64.b64decode(spoiled[0]["data"])
    got = {r.id: r.intact for r in archive.restored(spark.createDataFrame(spoiled, archive.archived(df, "id", "text", chunk_chars=16).schema), "id").collect()}
    assert got == {"a": False, "b": True}


def test_words_of_a_scope(spark):
    words = ["in_progress", "inprogress", "Ongoing", "active", "blocked", "no such word"]
    rows = spark.createDataFrame([("scope", w) for w in words], "domain string, word string")
    got = {r.word: r.canonical for r in vocabulary.normalised(rows, "domain", "word").collect()}
    assert got == {"in_progress": "active", "inprogress": "active", "Ongoing": "active", "active": "active", "blocked": "blocked", "no such word": None}
