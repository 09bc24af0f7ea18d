import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import messages as M
from loomline.functions import text as T
from loomline.functions import values as V


def over(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    return [r[0] for r in rows.select(f(F.col("x")).alias("v"), "k").orderBy("k").collect()]


def test_kinds(spark):
    assert over(spark, V.kind, "null", "true", "1", "2.5", '"a"', "[]", '{"a":1}', "{", None) == ["null", "boolean", "number", "number", "string", "array", "object", None, None]


def test_loose_bool(spark):
    assert over(spark, V.loose_bool, None, "null", "true", "1", "2", '" YES "', '"n"', '""', '"maybe"', "[]") == [False, False, True, True, False, True, False, False, None, None]


def test_confidence(spark):
    assert over(spark, V.confidence, None, "null", '" "', '"0.5"', '"7"', '"-1e3"', '"x"', "0.25", "1.5", "true") == [0.9, 0.9, 0.9, 0.5, 1.0, 0.0, None, 0.25, None, None]


def test_strings(spark):
    assert over(spark, lambda x: V.bounded_string(x, 5), '" ab "', '""', '"abcdef"', "3", '"a𝒳𝒳"', '"ab𝒳𝒳"') == ["ab", None, None, None, "a𝒳𝒳", None]
    assert over(spark, lambda x: T.first_units(x, F.lit(3)), "abcd", "a𝒳b", "ab𝒳", "𝒳𝒳", "") == ["abc", "a𝒳", "ab", "𝒳", ""]
    assert over(spark, lambda x: T.last_units(x, F.lit(3)), "abcd", "a𝒳b", "𝒳𝒳") == ["bcd", "𝒳b", "𝒳"]
    assert over(spark, V.worktree_state, '" clean "', '""', '{"a": [1.0, 2]}', "3", "null", None) == ["clean", None, '{"a":[1,2]}', None, None, None]


def test_times(spark):
    assert over(spark, V.any_millis, "12", '"1970-01-01T00:00:01Z"', '"soon"', "null", None) == [12, 1000, None, None, None]
    lines = ['{"timestamp":5,"message":{"timestamp":6}}', '{"timestamp":null,"message":{"timestamp":"x"}}', '{"message":[1]}', "{"]
    assert over(spark, V.record_time, *lines) == ["5", '"x"', None, None]


def test_json(spark):
    assert over(spark, V.canonical_json, '{"b":1.0,"a":{"d":[{"z":1,"y":"é"}],"c":null}}', "{", None) == ['{"a":{"c":null,"d":[{"y":"é","z":1}]},"b":1}', None, None]
    assert over(spark, V.repair_text, '" a "', "[1, \" b \", {\"c\": 2}, \"\"]", "true", "null", '{"a":1}') == ["a", '1; b; {"c":2}', "true", "", '{"a":1}']
    assert over(spark, V.loose_strings, '"a, b;a\\nc"', '["x", 1, null, {"name": " n "}, {"q": 1}, "x"]', "null", "5") == [["a", "b", "c"], ["x", "1", "n", '{"q":1}'], [], ["5"]]
    assert over(spark, V.count_exact("a"), '["a", {"a": "a", "b": ["a", "aa"]}]', '"a"', "1") == [3, 1, 0]
    (got,) = over(spark, V.redact_json, '{"k":["Bearer abcdefghijkl0123", {"url":"https://u:p@h/"}], "n": 1}')
    assert json.loads(got.value) == {"k": ["Bearer [REDACTED]", {"url": "https://[REDACTED]@h/"}], "n": 1} and got.replaced == 2


def test_message_parts(spark):
    shells = ['{"role":"bashExecution","command":"ls","output":"x"}', '{"role":"bashExecution","command":"ls","content":""}', '{"role":"bashExecution","content":[{"type":"text","text":"o"},"p"]}']
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(shells)], "k int, message string")
    assert [r[0] for r in M.with_message(rows).orderBy("k").select(M.shell_text()).collect()] == ["$ ls\nx", "$ ls", "o\np"]
    said = over(spark, M.without_thinking, '{"role":"assistant","content":[{"type":"thinking","thinking":"t"},{"type":"text","text":"a"}],"n":1}', '{"role":"user","content":[{"type":"thinking"}]}', "{")
    assert json.loads(said[0]) == {"role": "assistant", "content": [{"type": "text", "text": "a"}], "n": 1} and said[1:] == ['{"role":"user","content":[{"type":"thinking"}]}', "{"]
    blocks = '[{"type":"text","text":" a "},{"type":"image"},{"type":"text","text":"b"}]'
    assert over(spark, lambda x: M.custom_text(x, F.lit(True), joined=True), blocks, '"plain"') == ["a \nb", ""]
    assert over(spark, lambda x: M.custom_text(x, F.lit(False)), blocks, '"plain"', None) == [[" a ", "b"], ["plain"], []]


@pytest.mark.parametrize("cut", ["## Next\n", "### Other part\n", ""])
def test_excerpt(spark, cut):
    text = f"# Summary\nold\n## Conversation Excerpt\n[user] hi\n\n[assistant] yes\n{cut}"
    assert over(spark, M.excerpt, text, "no heading", "## conversation excerpt\n \n") == [f"{M.EXCERPT_MARK}\n[user] hi\n\n[assistant] yes", None, None]


def test_json_is_whole(spark):
    texts = ['{"a":1}', ' [1] ', "1", '{"a":1} x', "1,2", "1],[2", '1,"\\u0001"', "", None, "nul"]
    assert over(spark, lambda x: F.to_json(T.whole_json(x)), *texts) == ['{"a":1}', "[1]", "1", *[None] * 7]
