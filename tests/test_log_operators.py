import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomline.functions import messages as M
from loomline.functions import text as T
from loomline.operators import archive, branch, cache, constraints, ledger, merge, ordering, responses, schema_drift, segments, turns, vocabulary
from loomline.plans import clean
from loomline.sources import jsonl
from loomline.streaming import ingest


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("\n\na  \nb    \nc\t\t\n\n\n\n\nd\n\n", "a  \nb  \nc\n\n\nd"),
        ("```\nx   \n\n\n\n\ny\t\n```\nz\t", "```\nx   \n\n\n\n\ny\t\n```\nz"),
        ("```\na   \n~~~\nb   \n```\nc   ", "```\na   \n~~~\nb   \n```\nc  "),
        ("é", "é"),
        ("", ""),
    ],
)
def test_canonical(raw, want):
    assert T.canonical(raw) == want
    assert T.canonical(want) == want


def column(spark, texts, make):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", make(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("k").collect()]


def test_secrets(spark):
    texts = ["Bearer abcdefghijkl12", "Bearer short", "x api_key: 'verysecretvalue' y", "token = plainvalue123", "https://u:p@h.test/", "ésk-fakefakefakefake1", "mysql://a:b@c.test", None]
    want = ["Bearer [REDACTED]", "Bearer short", "x api_key: [REDACTED] y", "token = plainvalue123", "https://[REDACTED]@h.test/", "é[REDACTED_KEY]", "mysql://[REDACTED]@c.test", None]
    assert column(spark, texts, lambda x: T.redaction(x)["text"]) == want


def test_text_scalars(spark):
    assert column(spark, ["  A\tB　"], T.compact_lower) == ["a b"]
    assert column(spark, ["a😀b"], T.utf16_length) == [4]
    assert column(spark, ["In-Progress!", "  ", "é"], T.token_name) == ["in_progress", None, None]
    assert column(spark, ["2025-01-01T00:00:00.5Z", "1735689600000", "x", None], T.iso_millis) == [1735689600500, None, None, None]
    assert column(spark, ["abcde", "", "abcd"], lambda x: T.pieces(x, 2)) == [["ab", "cd", "e"], [""], ["ab", "cd"]]
    long = "h" * 2000
    assert column(spark, [long, " ok "], lambda x: T.bounded(x, 1000)) == ["h" * 400 + "\n...[1100 chars omitted by result-first prefilter]...\n" + "h" * 500, "ok"]


def test_scores(spark):
    c = lambda f: lambda x: f(T.compact_lower(x))
    assert column(spark, ["好的。", "我先看看", "已完成：测试通过", "", "done"], c(M.process_only)) == [True, True, False, True, False]
    assert column(spark, ["继续", "继续修复登录", "怎么这么慢", "fix it"], c(M.low_value)) == [True, False, True, False]
    assert column(spark, ["继续修复登录", "fix it"], c(M.continuation)) == [True, False]
    assert column(spark, ["已修复，根因是缓存", "pass 3/3"], c(M.milestone_score)) == [160, 125]


ENTRY = "source_id string, entry_id string, parent_id string, line_index long, entry_type string, message string, summary string, first_kept_entry_id string, text int"


def said(k, role, text="x", **more):
    return ("s", f"e{k}", f"e{k - 1}" if k else None, k, "message", json.dumps({"role": role, "content": text, **more}, ensure_ascii=False), None, None, 1)


def records(spark, rows):
    got = turns.turn_records(spark.createDataFrame(rows, ENTRY)).collect()
    return [(r.turn_index, r.mode, r.assistant_ids, r.tool_ids, r.user_ids) for r in sorted(got, key=lambda r: r.turn_index)]


def test_turns(spark):
    call = [{"type": "toolCall", "name": "edit"}, {"type": "text", "text": "calling"}]
    rows = [
        said(0, "user", "build it"), said(1, "assistant", "built"),
        said(2, "user", "test it"), said(3, "assistant", call), said(4, "toolResult", "Error: no", toolName="bash", isError=True), said(5, "user", "test  IT"), said(6, "user", "继续"), said(7, "toolResult", "file created", toolName="write"),
        said(8, "user", "next"), said(9, "assistant", "cut", stopReason="length"), said(10, "user", "and more"),
    ]
    assert records(spark, [*rows, rows[0]]) == [
        (1, "assistant_final", ["e1"], [], ["e0"]),
        (2, "evidence_fallback", ["e3"], ["e4", "e7"], ["e2"]),
        (3, "user_only", [], [], ["e8", "e10"]),
    ]
    assert records(spark, [said(0, "toolResult", "0 failed", toolName="bash"), said(1, "assistant", ""), said(2, "user", "好的")]) == [(1, "evidence_fallback", [], ["e0"], [])]
    assert records(spark, []) == []
    stats = turns.selection_stats(spark.createDataFrame(rows, ENTRY)).first()
    assert (stats.raw_messages, stats.degenerate, stats.turns, stats.finals, stats.fallbacks, stats.selected, stats.dropped) == (11, 1, 3, 1, 1, 8, 3)


def test_message_shapes(spark):
    shapes = ['{"role":"user","content":["a",{"type":"text","text":"b"}]}', '{"role":"user","content":"[1]"}', '{"role":"user"}', '{"role":', "[1]", None]
    rows = [("s", str(k), None, k, "message", m, None, None, 1) for k, m in enumerate(shapes)]
    got = {r.entry_id: r.texts for r in M.with_message(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got["1"] == ["[1]"] and got["2"] == got["3"] == got["4"] == got["5"] == []


def test_branch_and_effective_context(spark):
    def e(k, parent, kind="message", kept=None):
        return ("s", f"e{k}", parent, k, kind, None, None, kept, 1)

    rows = [e(0, None), e(1, "e0"), e(2, "e1"), e(3, "e1"), e(4, "e3", "compaction", "e3"), e(5, "e4")]
    df = spark.createDataFrame([*rows, rows[5], ("t", "a", "b", 1, "message", None, None, None, 1), ("t", "b", "a", 0, "message", None, None, None, 1), (None, "n", "gone", 0, "x", None, None, None, 1)], ENTRY)
    for local_rows in (1000, 0):
        path = {(r.source_id, r.entry_id): (r.depth, r.whole) for r in branch.active_branch(df, local_rows).collect()}
        assert path == {("s", "e0"): (0, True), ("s", "e1"): (1, True), ("s", "e3"): (2, True), ("s", "e4"): (3, True), ("s", "e5"): (4, True), (None, "n"): (0, False)}
    order = [r.entry_id for r in branch.effective_entries(df).filter("source_id = 's'").orderBy("position").collect()]
    assert order == ["e4", "e3", "e5"]
    faults = {r.source_id: (r.entries, r.repeated, r.roots, r.lost_parents, r.looped, r.sound) for r in branch.tree_faults(df).collect()}
    assert faults == {"s": (6, 1, 1, 0, 0, False), "t": (2, 0, 0, 0, 2, False), None: (1, 0, 0, 1, 0, False)}


SEGMENT = "segment_id long, source_id string, source_order int, seg_kind string, text string, occurred_at timestamp"


def test_segments(spark):
    near = "word " * 40
    rows = [(1, "a", 1, "user", "hi ", None), (2, "a", 2, "user", "hi", None), (3, "a", 3, "tool", "hi", None), (4, "a", 2500, "tool", "hi", None), (5, None, None, "user", None, None), (6, "b", 1, "user", "", None)]
    df = spark.createDataFrame(rows, SEGMENT)
    assert {r.segment_id: r.repeated for r in segments.without_adjacent(df).collect()} == {1: False, 2: True, 3: False, 4: True}
    blocks = [r.block for r in clean.rendered(df).orderBy("position").collect()]
    assert blocks == ["用户：\nhi ", "用户：\nhi", "工具：\nhi", "工具：\nhi"]
    total = {r.source_id: (r.input_segments, r.output_segments, r.reduction_pct) for r in clean.summary(df).collect()}
    assert total == {"a": (4, 4, 0.0), "b": (1, 0, 0.0), None: (1, 0, 0.0)}
    both = [(1, "a", 1, "user", near, None), (2, "b", 2, "user", near + "!! tail".replace("tail", ""), None), (3, "c", 3, "user", "short", None), (4, "d", 4, "user", near + "w", None), (5, "e", 5, "user", "```\n" + near, None)]
    df = spark.createDataFrame(both, SEGMENT).withColumn("g", F.lit(1))
    assert [tuple(r) for r in merge.boundary_near(df, "g", ["source_order", "segment_id"]).collect()] == [(1, 2)]


def test_packing(spark):
    df = spark.createDataFrame([("g", k, n) for k, n in enumerate([10, 10, 30, 5, 5, 5])], "g string, o int, n int")
    assert [r.chunk for r in segments.pack(df, "g", ["o"], "n", most=22).orderBy("o").collect()] == [1, 1, 2, 3, 3, 3]
    parts = segments.split_oversized("a" * 15 + "\n" + "b" * 15, 20)
    assert parts == ["[oversized block part 1/2]\n" + "a" * 15, "[oversized block part 2/2]\n" + "b" * 15]
    assert segments.split_oversized("c" * 25, 20)[0].endswith("c" * 20)


def test_overlaps(spark):
    rows = [(s, k, x) for s, word in (("l", "xabab"), ("r", "ababq"), ("n", "zz")) for k, x in enumerate(word)]
    pairs = spark.createDataFrame([("l", "r"), ("l", "n"), ("n", "n"), ("l", "gone"), (None, "r")], "left string, right string")
    got = {(r.left, r.right): r.overlap for r in merge.overlaps(pairs, spark.createDataFrame(rows, "source string, place int, signature string")).collect()}
    assert got == {("l", "r"): 4, ("l", "n"): 0, ("n", "n"): 2, ("l", "gone"): 0}


def test_overlaps_broadcast_no_rows(spark):
    """Rows made by splitting a short table count as short in the plan, however many they are."""
    few = spark.range(20).select(F.concat(F.lit("s"), "id").alias("source"))
    rows = few.select("source", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("place")).withColumn("signature", F.concat_ws(":", "source", F.col("place") % 10))
    got = merge.overlaps(few.select(F.col("source").alias("left"), F.col("source").alias("right")), rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert {(r.left, r.right): r.overlap for r in got.collect()} == {(f"s{k}", f"s{k}"): 100 for k in range(20)}


def test_session_overlaps_compare_content(spark, tmp_path):
    from loomline.reference_queries import session_content_overlaps

    rows = [("a", "user", "one"), ("a", "user", "two"), ("a", "tool", "three"), ("b", "user", " two"), ("b", "tool", "three"), ("b", "user", "four"), ("c", "user", "other"), ("c", "tool", "three")]
    spark.createDataFrame([(k, s, k, kind, t, None) for k, (s, kind, t) in enumerate(rows)], SEGMENT).write.parquet(f"{tmp_path}/visible_segments.parquet")
    spark.createDataFrame([("a", "/a", None), ("b", "/b", "/a"), ("c", "/c", "/a"), ("d", "/d", "/b")], "source_id string, source_path string, parent_session string").write.parquet(f"{tmp_path}/sessions.parquet")
    got = {(r.left, r.right): r.overlap for r in session_content_overlaps(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 0, ("b", "d"): 0}


def test_merge_order():
    d = lambda i, path, parent, created, index: {"id": i, "path": path, "parent": parent, "created": created, "index": index}
    assert clean.merge_order([d("c", "pc", "pa", 1, 0), d("a", "pa", None, 5, 1), d("b", "pb", "gone", None, 2)]) == ["a", "c", "b"]
    assert clean.merge_order([d("x", "px", "py", 2, 0), d("y", "py", "px", 1, 1)]) == ["y", "x"]


DOCUMENT = "merge string, source_id string, source_path string, parent_session string, created_ms long"


def plain_merge(documents, segments_of):
    """The pipeline as a plain fold over lists: ids of the kept segments and the numbers removed."""
    removed = {"exact": 0, "overlap": 0, "near": 0}

    def text_of(s):
        t = T.canonical(s[4])
        return T.canonical(re.sub(r"sk-[A-Za-z0-9_-]{16,}", "[REDACTED_KEY]", t))

    def sign(s):
        return s[3], re.sub("\n{2,}", "\n", re.sub("[\t ]+", " ", text_of(s))).strip()

    def adjacent(rows):
        out = []
        for s in rows:
            if out and sign(out[-1]) == sign(s):
                removed["exact"] += 1
            else:
                out.append(s)
        return out

    docs = {d[1]: adjacent(sorted((s for s in segments_of[d[1]] if text_of(s)), key=lambda s: (s[2], s[0]))) for d in documents}
    order = clean.merge_order([{"id": d[1], "path": d[2], "parent": d[3], "created": d[4], "index": d[1]} for d in documents])
    seen, out = set(), []
    for i in order:
        mark = tuple(map(sign, docs[i]))
        if mark in seen:
            removed["exact"] += len(docs[i])
            continue
        seen.add(mark)
        start = next((k for k in range(min(len(out), len(docs[i])), 0, -1) if [sign(s) for s in out[-k:]] == [sign(s) for s in docs[i][:k]]), 0)
        removed["overlap"] += start
        out += docs[i][start:]
    final = []
    for s in adjacent(out):
        if final:
            a, b = final[-1], s
            short, long = sorted((re.sub(r"[\W_]+", "", text_of(x).lower()) for x in (a, b)), key=len)
            if a[3] == b[3] and a[1] != b[1] and min(len(text_of(a)), len(text_of(b))) >= 80 and short in long and len(short) >= 0.98 * len(long):
                removed["near"] += 1
                final[-1] = b if len(text_of(b)) > len(text_of(a)) else a
                continue
        final.append(s)
    return [s[0] for s in final], removed


def test_whole_cleaning_of_merged_documents(spark):
    """Repeats within and between documents, whole copies, overlaps over several documents and near repeats, against a plain fold."""
    r = random.Random(3)
    long = ["word " * 40 + "a", "word " * 40 + "ab", "text, " * 30, "text " * 30 + "!"]
    documents, rows, of = [], [], {}
    for m in range(12):
        lines = [(r.choice(["user", "assistant"]), r.choice(["hi", "hi ", "yes", "key sk-" + "x" * 20, "key sk-" + "y" * 20, *long])) for _ in range(14)]
        for d in range(6):
            source = f"s{m}_{d}"
            parent = r.choice([None, "gone", *(f"/{m}/{k}" for k in range(d))]) if m else f"/{m}/{(d + 1) % 6}"
            documents.append((f"m{m}", source, f"/{m}/{d}", parent, r.choice([None, 5, 7, d])))
            a = r.randrange(8)
            said = r.choice([lines[a : a + r.randrange(7)], lines[:5], lines[3:9], lines[7:]])
            of[source] = [(len(rows) + k, source, k // 2, kind, text, None) for k, (kind, text) in enumerate(said)]
            rows += of[source]
    alone = [(9001, "free", 1, "user", "hi", None), (9002, "free", 2, "user", "hi", None), (9003, None, 1, "user", "hi", None), (9004, None, 2, "tool", "hi", None)]
    table, listed = spark.createDataFrame(rows + alone, SEGMENT), spark.createDataFrame(documents, DOCUMENT)
    want = {f"m{m}": plain_merge([d for d in documents if d[0] == f"m{m}"], of) for m in range(12)} | {"free": ([9001], {"exact": 1, "overlap": 0, "near": 0}), None: ([9003, 9004], {"exact": 0, "overlap": 0, "near": 0})}
    out = clean.merged(table, clean.Policy(), listed).cache()
    got = defaultdict(list)
    for x in out.filter("fate = 'kept'").orderBy("m", "ord", "place").collect():
        got[x.merge].append(x.segment_id)
    assert dict(got) == {m: ids for m, (ids, _) in want.items() if ids}
    assert {x.fate for x in out.select("fate").collect()} == {"kept", "exact", "document", "overlap", "near"}
    total = {x.merge: (x.output_segments, {"exact": x.exact_removed, "overlap": x.overlap_removed, "near": x.near_removed}) for x in clean.summary(table, clean.Policy(), listed).collect()}
    assert total == {m: (len(ids), n) for m, (ids, n) in want.items()}
    blocks = clean.rendered(table, clean.Policy(), listed).filter("merge = 'm1'").orderBy("position").collect()
    assert [b.position for b in blocks] == list(range(1, len(want["m1"][0]) + 1)) and not any("sk-" in b.block for b in blocks)
    assert [b.block for b in clean.rendered(table, clean.Policy()).filter("source_id = 'free'").collect()] == ["用户：\nhi"]


def test_suffix_prefix():
    r = random.Random(1)
    for _ in range(500):
        a, b = r.choices("ab", k=r.randrange(7)), r.choices("ab", k=r.randrange(7))
        assert clean.suffix_prefix(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])


def test_archive_round_trip_and_tampering(spark):
    df = spark.createDataFrame([(1, "héllo\n" * 500), (2, ""), (3, None)], "k long, t string")
    chunks = archive.archived(df, "k", "t", chunk_chars=16).cache()
    assert {r.k: (r.text, r.intact) for r in archive.restored(chunks, "k").collect()} == {1: ("héllo\n" * 500, True), 2: ("", True)}
    bad = chunks.withColumn("data", F.when((F.col("k") == 1) & (F.col("chunk_index") == 2), F.translate("data", "ABCDEFGHIJKLMabcdefghijklm", "NOPQRSTUVWXYZnopqrstuvwxyz")).otherwise(F.col("data")))
    assert not archive.restored(bad, "k").filter("k = 1").first().intact
    assert not archive.restored(chunks.filter("k <> 1 or chunk_index <> 1"), "k").filter("k = 1").first().intact


def test_positions(spark):
    df = spark.createDataFrame([("a", k % 7, k) for k in range(200)] + [(None, 1, 1)], "g string, x int, y int")
    got = ordering.position_in_group(df, "g", [F.col("x"), F.col("y")]).collect()
    want = {("a", x, y): n for n, (x, y) in enumerate(sorted((k % 7, k) for k in range(200)), 1)} | {(None, 1, 1): 1}
    assert {(r.g, r.x, r.y): r.position for r in got} == want


def test_constraints(spark):
    schema = "id string, statement string, level string, status string, supersedes string, evidence array<string>"
    old = [("1", "Keep the API stable", "hard", "active", None, []), ("2", "Use  Postgres only", "hard", "active", None, []), ("3", "no tabs", "hard", "active", None, []), ("4", "soft one", "soft", "active", None, []), ("5", "Never touch the billing code", "hard", "active", None, [])]
    new = [("9", "use postgres, only".replace(",", "，"), "hard", "active", None, []), ("8", "x", "hard", "active", "touch the billing", ["e"]), ("7", "y", "hard", "active", "no tabs", [])]
    got = {(r.id, r.inherited) for r in constraints.preserved(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {("9", False), ("8", False), ("7", False), ("1", True), ("3", True)}


CONSTRAINT = "id string, statement string, level string, status string, supersedes string, evidence array<string>"


def test_constraints_with_common_beginnings_meet_only_by_what_is_rare(spark, monkeypatch):
    """Each new text holds one old text or is held by one; all begin alike."""
    n, tested = 300, spark.sparkContext.accumulator(0)

    def counted(whole, part):
        def run(w, p):
            tested.add(1)
            return p in w

        return F.udf(run, "boolean")(whole, part)

    monkeypatch.setattr(constraints.F, "contains", counted)
    old = [(f"c{k}", f"Statement number {k} is kept", "hard", "active", None, []) for k in range(1000, 1000 + n)]
    new = [(f"n{k}", f"new {k}", "hard", "active", [f"no longer: statement number {k} is kept", f"number {k} is", None][k % 3], ["e"]) for k in range(1000, 1000 + n)]
    got = [r.id for r in constraints.preserved(spark.createDataFrame(old, CONSTRAINT), spark.createDataFrame(new, CONSTRAINT)).filter("inherited").collect()]
    assert sorted(got) == [f"c{k}" for k in range(1000, 1000 + n) if k % 3 == 2]
    assert tested.value <= 4 * n


@pytest.mark.parametrize("seed", [1, 2])
def test_contained(spark, seed):
    """Against every pair, with repeats inside texts and lengths about the sizes of stretches."""
    r = random.Random(seed)
    wholes = {"".join(r.choices("abé", weights=[8, 2, 1], k=r.choice([8, 9, 16, 17, 31, 64, 90]))) for _ in range(150)} | {"a" * 40, "ab" * 20}
    parts = {w[i : i + r.choice([8, 9, 15, 16, 17, 32, 33])] for w in wholes for i in (0, 3)} | {"".join(r.choices("ab", k=r.choice([8, 12, 16]))) for _ in range(100)} | {"a" * 33}
    parts = {p for p in parts if len(p) >= 8}
    got = [tuple(x) for x in constraints.contained(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string")).collect()]
    assert sorted(got) == sorted((p, w) for p in parts for w in wholes if p in w)


def test_ledgers(spark):
    facts = spark.createDataFrame(
        [("l", "a", "d", "s", "state", "current", "X"), ("l", "b", "d", "s", "state", "current", "Y"), ("l", "c", "d", "s", "note", "superseded", " x "), ("l", "c", "e", "s", "note", "superseded", "z")],
        "ledger_id string, fact_id string, domain string, subject string, category string, status string, statement string",
    )
    got = {(r.fact_id, r.violation) for r in ledger.repeated(facts).collect()}
    assert got == {("c", "repeated id"), ("a", "repeated statement"), ("c", "repeated statement"), ("a", "two current states"), ("b", "two current states")}
    links = spark.createDataFrame([("l", "a", "b"), ("l", "a", "a"), ("l", "a", "no"), ("l", "x", "y"), ("l", "y", "x")], "ledger_id string, fact_id string, target_id string")
    assert {(r.fact_id, r.violation) for r in ledger.broken_links(facts, links).collect()} >= {("a", "no such target"), ("a", "wrong target")}
    assert {r.fact_id for r in ledger.in_loops(links).collect()} == {"a", "x", "y"}
    want, have = (spark.createDataFrame([("l", s) for s in x], "ledger_id string, source_id string") for x in ("ab", "bbc"))
    assert {(r.source_id, r.violation) for r in ledger.uncovered(want, have).collect()} == {("a", "missing"), ("c", "extra"), ("b", "repeated")}
    texts = spark.createDataFrame([("i", "ACT-0123456789"), ("i", "ACT-aaaaaaaaaa"), ("i", "see ACT-aaaaaaaaaa")], "item_id string, text string")
    kept = {r.text for r in ledger.without_phantoms(texts, spark.createDataFrame([("act-0123456789",)], "id string")).collect()}
    assert kept == {"ACT-0123456789", "see ACT-aaaaaaaaaa"}


def test_cache(spark, tmp_path):
    path, a, b = str(tmp_path / "c"), {"model": "m", "promptVersion": "1", "s": 1}, {"s": 2, "promptVersion": "1", "model": "m"}
    rows = lambda *x: spark.createDataFrame(x, "name string, input_hash string, value string")
    assert cache.key_of(a) == cache.key_of(dict(reversed(a.items()))) != cache.key_of(b)
    cache.store(rows(("n", "h", "1"), ("bad", "h", "{")), path, a)
    cache.store(rows(("n", "h", "2"), ("o", "h", "3")), path, a)
    wanted = rows(("n", "h", ""), ("n", "other", ""), ("bad", "h", "")).drop("value")
    for identity in (a, b):
        got = {(r.name, r.input_hash): r.value for r in cache.lookup(wanted, cache.stored(spark, path), identity).collect()}
        assert got == {("n", "h"): "1", ("n", "other"): None, ("bad", "h"): None}
    assert cache.lookup(wanted, cache.stored(spark, str(tmp_path / "none")), a).filter("value is not null").count() == 0


def test_responses(spark):
    texts = ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":{"b":"}"}} end', "none", "[1]", "{bad}", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    assert [r.object for r in responses.objects(df).orderBy("k").collect()] == ['{"a":1}', '{"a":2}', '{"a":{"b":"}"}}', None, None, None, None, None]
    assert [r.object for r in responses.objects(df, strict=True).orderBy("k").collect()][1] is None


def test_vocabulary(spark):
    df = spark.createDataFrame([("severity", "Blocker"), ("severity", ""), ("claim", "self report"), ("claim", "?"), (None, None)], "d string, w string")
    assert [r.canonical for r in vocabulary.normalised(df, "d", "w").collect()] == ["critical", "high", "uncertain", None, None]


def test_session_files(spark, tmp_path):
    lines = ['{"type":"session","id":"s1","version":3,"cwd":"/w"}', '{"type":"message","id":"a","parentId":null,"message":{"role":"user","content":"hi"}}', "", '{"type":"custom","id":"b","parentId":"a"}', '{"type":"x"}']
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    headers, entries = jsonl.read_sessions(spark, str(tmp_path / "one.jsonl"))
    assert headers.select("source_id", "format_version", "cwd").collect() == [("s1", 3, "/w")]
    got = entries.orderBy("line_index").collect()
    assert [(r.entry_id, r.parent_id, r.line_index) for r in got] == [("a", None, 1), ("b", "a", 3)]
    assert json.loads(got[0].message) == {"role": "user", "content": "hi"}
    jsonl.write_lines(entries, str(tmp_path / "out"))
    back = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert back == sorted([lines[1], lines[3]])
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines, "{no"]))
    with pytest.raises(Exception, match="unreadable: line 5"):
        jsonl.read_sessions(spark, str(tmp_path / "bad.jsonl"))[1].collect()
    assert jsonl.read_sessions(spark, str(tmp_path / "bad.jsonl"), strict=False)[1].count() == 2


def test_session_files_read_in_blocks(spark, tmp_path):
    """Lines keep their places where a file is read by several tasks; exact lines, headers that are missing."""
    (tmp_path / "a.jsonl").write_text('{"type":"session","id":"a"}\n' + "".join('{"type":"message","id":"%d"}\r\n\n' % k for k in range(300)))
    (tmp_path / "b.jsonl").write_text('{"type":"message","id":"x"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1_000)
    try:
        lines = jsonl.read_lines(spark, str(tmp_path / "a.jsonl"), exact=True)
        assert lines.rdd.getNumPartitions() > 3
        got = {r.line_index: r.raw for r in lines.collect()}
        assert got == dict(enumerate((tmp_path / "a.jsonl").read_text().split("\n")[:-1])) or got == dict(enumerate((tmp_path / "a.jsonl").read_bytes().decode().split("\n")[:-1]))
        _, entries = jsonl.read_sessions(spark, str(tmp_path / "a.jsonl"))
        assert {(r.entry_id, r.line_index) for r in entries.collect()} == {(str(k), 1 + 2 * k) for k in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="no header"):
        jsonl.read_sessions(spark, str(tmp_path / "*.jsonl"))[0].collect()
    with pytest.raises(Exception, match="unreadable"):
        jsonl.read_sessions(spark, str(tmp_path / "a.jsonl"), exact=True)[1].collect()
    headers, entries = jsonl.read_sessions(spark, str(tmp_path / "*.jsonl"), strict=False)
    assert {(r.source_id, r.format_version) for r in headers.collect()} == {("a", 1), ("source-1", 1)} and entries.filter("source_id = 'source-1'").count() == 1


def test_hourly_counts_close_with_the_watermark(spark, tmp_path):
    rows = [(f"2025-01-0{d} 0{h}:30:00", t) for d, h, t in [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (5, 1, "a")]]
    spark.createDataFrame(rows, "at string, entry_type string").selectExpr("cast(at as timestamp) as ingested_at", "entry_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ingested_at timestamp, entry_type string").parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.hourly(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.window.start.hour, r.entry_type, r.lines) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "a", 2), (2, "b", 1)}


def test_latest_valid_report(spark):
    df = spark.createDataFrame([("a", 1, "x", True), ("a", 2, "y", False), ("b", 1, "z", False)], "source_id string, place int, data string, valid boolean")
    assert [tuple(r) for r in responses.latest_valid(df).collect()] == [("a", 1, "x")]


def test_stream_of_lines(spark, tmp_path):
    rows = [("s", "a", "message", "2025-01-01 00:00:00"), ("s", "a", "message", "2025-01-02 00:00:00"), ("s", "b", "message", "2025-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "source_id string, entry_id string, entry_type string, t string").select("source_id", "entry_id", "entry_type", F.to_timestamp("t").alias("ingested_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.once_per_line(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.entry_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


RAW = "record_id long, stream_id string, file_name string, file_seq long, line_index int, record_kind string, received_at timestamp, raw_text string"


def test_schema_drift(spark):
    def lines(name, seq, *texts, stream="s"):
        return [(hash((name, k)) % 1000, stream, name, seq, k, "header", None, t) for k, t in enumerate(texts)]

    rows = [
        *lines("f1", 1, '{"id":"0a1b2c3d-0001","v":3,"t":"2025-01-01T00:00:00Z","o":{"x":1},"l":[{"p":"u"}],"n":null}', "", "{bad", None, "[1]"),
        *lines("f2", 4, '{"sessionId":"0b1b2c3d-0002","v":"v3","t":"2025-01-02T00:00:00Z","o":{"x":true},"l":[],"e":[]}', '{"sessionId":null,"l":[{"p":"w"}]}'),
        *lines("f3", 5, '{"sessionId":"0c1b2c3d-0002","v":"v3","startedAt":"2025-01-03T00:00:00Z","pinned":true,"l":[{"p":"u"}]}'),
        *lines("g1", 2, '{"a":1}', stream=None), *lines("g2", None, '{"b":"x"}', stream=None), *lines("h1", 1, '{"a":1}', stream="other"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], RAW)
    got = {tuple(r) for r in schema_drift.drift(df).collect()}
    assert got == {
        ("f2", "id", "sessionId", "renamed"), ("f2", "v", "v", "retyped"), ("f2", "o.x", "o.x", "retyped"), ("f2", "", "e", "added"),
        ("f3", "t", "startedAt", "renamed"), ("f3", "o.x", "", "removed"), ("f3", "e", "", "removed"), ("f3", "", "pinned", "added"),
        ("g1", "b", "", "removed"), ("g1", "", "a", "added"),
    }
    assert schema_drift.drift(df.limit(0)).count() == 0
    types = {r.field: r.type for r in schema_drift.fields(df).collect()}
    assert types["v"] == "string" and types["o.x"] == "long" and types["pinned"] == "boolean" and types["e"] == "array"
    table = schema_drift.unified(df, "header")
    assert table.count() == 8 and dict(table.dtypes)["o.x"] == "bigint"
    assert {r["v"] for r in table.collect()} == {"3", "v3", None}


def test_drift_of_sets_larger_than_a_profile(spark):
    """Values beyond the profile decide a rename: by rows, with the same result as whole profiles."""
    def lines(name, seq, field, begin):
        return [(k, "s", name, seq, k, "header", None, '{"%s":"word %s","z":[%s]}' % (field, "abcdefghijklmnopqrstuvwxyz"[(begin + k) % 26] * 3, k)) for k in range(26)]

    df = spark.createDataFrame([*lines("f1", 1, "alpha", 0), *lines("f2", 2, "omega", 5), *lines("f3", 3, "sigma", 9)], RAW)
    want = {("f2", "alpha", "omega", "renamed"), ("f3", "omega", "sigma", "renamed")}
    for kept in (2, 64):
        assert {tuple(r) for r in schema_drift.drift(df, kept).collect()} == want
    log = schema_drift.changes(df, 2).orderBy("file_seq", "change_no").collect()
    assert [(r.stream_id, r.file_seq, r.change_no, r.change_kind) for r in log] == [("s", 2, 1, "renamed"), ("s", 3, 1, "renamed")]


def test_one_file_name_in_two_streams(spark):
    df = spark.createDataFrame([(k, s, f, n, 0, "header", None, t) for k, (s, f, n, t) in enumerate([("s", "f1", 1, '{"a":1}'), ("s", "f2", 2, '{"a":"x"}'), ("t", "f1", 1, '{"b":1}'), ("t", "f2", 2, '{"c":true}')])], RAW)
    got = {(r.stream_id, r.old_field, r.new_field, r.change_kind) for r in schema_drift.changes(df).collect()}
    assert got == {("s", "a", "a", "retyped"), ("t", "b", "", "removed"), ("t", "", "c", "added")}


def test_long_numbers_stay_whole(spark):
    df = spark.createDataFrame([(1, "s", "f", 1, 0, "header", None, '{"n":9007199254740993,"d":1}'), (2, "s", "f", 1, 1, "header", None, '{"n":true,"d":1.5}')], RAW)
    table = schema_drift.unified(df, "header")
    assert {(r["n"], r["d"]) for r in table.collect()} == {(9007199254740993, 1.0), (1, 1.5)}


def test_type_lattice():
    kinds = [None, "boolean", "number", "string", "array"]
    for a in kinds:
        assert schema_drift.promote(a, a) == a
        for b in kinds:
            assert schema_drift.promote(a, b) == schema_drift.promote(b, a)
            for c in kinds:
                assert schema_drift.promote(schema_drift.promote(a, b), c) == schema_drift.promote(a, schema_drift.promote(b, c))
