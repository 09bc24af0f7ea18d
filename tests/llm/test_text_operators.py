import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import conversations, leakage, mixing, near_duplicates, pii, reading
from loomline.llm.conversations import kind_of
from loomline.llm.words import words

PARTS = [(g, "given") for g in ("Orla", "Silas", "Mark", "Jarek")] + [
    (f, "family") for f in ("Ashbrand", "Ashloway", "Caldloway", "Caldmerrow", "Fenmerrow", "Fenloway", "Fenbrand", "Caldbrand", "Ashmerrow")
]
KNOWN = pii.Names.learn(PARTS)


def found(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.find(text, KNOWN)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("cc: a.b+c@mail.x.example, bye", [("email", "a.b+c@mail.x.example")]),
        ("to kim (at) x (dot) test now", [("email", "kim (at) x (dot) test")]),
        ("Cloned git@repo.x.example:a/b.git; @a/b@1.2.3; Add @slot in a.test", []),
        ("call +1 (305) 555-0166 today", [("phone", "+1 (305) 555-0166")]),
        ("tel=808-555-0138 x20; zone=b", [("phone", "808-555-0138 x20")]),
        ("Text 0049-30-23125-132 if", [("phone", "0049-30-23125-132")]),
        ("form field: SSN 916 98 3309", [("id_number", "916 98 3309")]),
        ("has passport no. Z8439630; trace K6384150 took 1.5", [("id_number", "Z8439630")]),
        ("Run 1758880830024 stopped at byte 1274407392.", []),
        ("pay GB82 WEST 1234 5698 7654 32 now", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
        ("pay GB83 WEST 1234 5698 7654 32 now", []),
        ("addr = '758 West Elm St., Unit 4, Burg, 00434'", [("address", "758 West Elm St., Unit 4, Burg, 00434")]),
        ("lives at Lindstraße 72, 00351 Marrow.", [("address", "Lindstraße 72, 00351 Marrow")]),
        ("See section 32 Road Map, rows 12-30.", []),
        ("Ask ORLA van der Ashbränd about it", [("name", "ORLA van der Ashbränd")]),
        ("Customer Caldloway, Mark, left", [("name", "Caldloway, Mark")]),
        ("by Grace T. Fenbrand-Ashloway", [("name", "Grace T. Fenbrand-Ashloway")]),
        ("Will the Session Writer Mark it? Orla left.", []),
        ("orla.ashbrand@x.test", [("email", "orla.ashbrand@x.test")]),
        ("pay with 4111 1111 1111 1111 today", [("id_number", "4111 1111 1111 1111")]),
        ("pay with 4111 1111 1111 1112 today", []),
        ("amex 3782 822463 10005 was declined", [("id_number", "3782 822463 10005")]),
        ("trace 4111111111111111 ended", []),
        ("call me at 415 555 0132", [("phone", "415 555 0132")]),
        ("counts 415 555 0132", []),
        ("to gb82 west 1234 5698 7654 32 please", [("id_number", "gb82 west 1234 5698 7654 32")]),
        ("ref 000-00-0000 done", []),
        ("he is at 10 Downing St all day", [("address", "10 Downing St")]),
        ("rendezvous 12 Rue de la Paix, 75002 Paris", [("address", "12 Rue de la Paix, 75002 Paris")]),
        ("see section 10 Downing St", []),
        ("", []),
    ],
)
def test_pii_spans(text, want):
    assert found(text) == want


#: Sentences of frames that played no part in choosing patterns and words.
HELD_OUT = [
    ("The minutes were typed up by Mark Fenbrand last night.", [("name", "Mark Fenbrand")]),
    ("Mark Fenbrand's flight lands at nine", [("name", "Mark Fenbrand")]),
    ("Both Orla Caldmerrow and Silas Ashloway signed it.", [("name", "Orla Caldmerrow"), ("name", "Silas Ashloway")]),
    ("Our witness, Jarek J. Fenloway, could not attend", [("name", "Jarek J. Fenloway")]),
    ("SSN on file is 123-45-6789.", [("id_number", "123-45-6789")]),
    ("Wire the deposit to DE89 3704 0044 0532 0130 00 by Friday", [("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("He paid with 5500 0000 0000 0004 at the till", [("id_number", "5500 0000 0000 0004")]),
    ("My new number: (212) 555-0147", [("phone", "(212) 555-0147")]),
    ("try me on +44 20 7946 0958 after six", [("phone", "+44 20 7946 0958")]),
    ("Fax machine lives at 030 23125 0140.", [("phone", "030 23125 0140")]),
    ("Contact: jo.smith@corp.example or the lobby", [("email", "jo.smith@corp.example")]),
    ("write to <first.last+news@sub.mail.example>, thanks", [("email", "first.last+news@sub.mail.example")]),
    ("We moved to 221 Baker Street, London NW1 6XE in May", [("address", "221 Baker Street, London NW1 6XE")]),
    ("The shop at 1600 Elm Avenue, Springfield, 62704 closed", [("address", "1600 Elm Avenue, Springfield, 62704")]),
    ("Bring it to Gartenweg 7, 10115 Berlin today", [("address", "Gartenweg 7, 10115 Berlin")]),
    ("passport C01X00T47 was renewed", [("id_number", "C01X00T47")]),
    ("national insurance number QQ 12 34 56 C on the slip", [("id_number", "QQ 12 34 56 C")]),
    ("her tax id: 86095742719", [("id_number", "86095742719")]),
    ("commit 4f5e6d7c8b9a pushed by ci", []),
    ("version 2.14.7 took 415 ms on port 8080", []),
    ("order 4111111111111112 shipped in 3 boxes", []),
    ("ranges 10-20-3000 and 1-2-3 were skipped", []),
    ("See Section 12 Main Street Design of the report", []),
    ("trace 123-45-6789-00 ended at 1758880830024", []),
    ("Mark the ticket, Orla said, before Release Day", []),
    ("npm i @scope/pkg@1.2.3 && git clone git@host.example:x/y.git", []),
    ("Deploy Window Monday 0900-1100, build 20250101.12", []),
]


def test_pii_in_other_frames():
    want = {(t, *x) for t, xs in HELD_OUT for x in xs}
    got = {(t, *x) for t, _ in HELD_OUT for x in found(t)}
    assert got == want


def test_pii_table(spark):
    schema = "source_id string, entry_id string, entry_type string, message string, summary string, pii_text int"
    rows = [
        ("s", "1", "message", '{"role":"user","content":"mail a@b.test"}', None, 1),
        ("s", "1", "message", '{"role":"user","content":"mail a@b.test"}', None, 1),
        ("s", "2", "message", '{"role":"tool","content":[{"type":"text","text":"a@b.test"},{"type":"x"},"c@d.test"]}', None, 1),
        ("s", "3", "message", '{"role":', None, 1),
        ("s", "4", "compaction", None, "to e@f.test", None),
        ("s", "5", "custom", None, None, None),
        (None, None, "message", '{"content":null}', "", None),
    ]
    parts = spark.createDataFrame([*PARTS, (None, None)], "part_text string, part_kind string")
    got = {tuple(r) for r in pii.found(spark.createDataFrame(rows, schema), parts).collect()}
    assert got == {("s", "1", "email", "a@b.test"), ("s", "2", "email", "a@b.test"), ("s", "2", "email", "c@d.test"), ("s", "4", "email", "e@f.test")}
    made = {tuple(r) for r in pii.redacted(spark.createDataFrame(rows, schema), parts).collect()}
    assert made == {
        ("s", "1", "content", 0, "mail [EMAIL]", 1), ("s", "2", "content", 0, "[EMAIL]", 1), ("s", "2", "content", 2, "[EMAIL]", 1),
        ("s", "4", "summary", 0, "to [EMAIL]", 1), (None, None, "summary", 0, "", 0),
    } - {(None, None, "summary", 0, "", 0)}
    clean = pii.cleaned(spark.createDataFrame(rows, schema), parts)
    assert clean.columns == schema.replace(",", "").split()[::2] and [r.message for r in clean.collect()] == [
        '{"role": "user", "content": "mail [EMAIL]"}', '{"role": "user", "content": "mail [EMAIL]"}',
        '{"role": "tool", "content": [{"type": "text", "text": "[EMAIL]"}, {"type": "x"}, "[EMAIL]"]}', '{"role":', None, None, '{"content":null}',
    ]
    assert pii.found(spark.createDataFrame([], schema), parts).count() == 0


def test_pii_long_text():
    assert len(found("x " * 200_000 + "a@b.test")) == 1


TALK = "source_id string, entry_id string, parent_id string, line_index long, entry_type string, message string, ts_ms long, role int"


def say(source, entry, parent, line, role, text, kind="message"):
    body = None if role is None else '{"role":"%s","content":"%s"}' % (role, text)
    return (source, entry, parent, line, kind, body, None if line is None else line * 1000, None)


def talk_rows():
    return [
        say("a", "r", None, 0, None, None, "custom"), say("a", "1", "r", 1, "user", "hi"), say("a", "2", "1", 2, "AI", "yes"), say("a", "2", "1", 2, "AI", "yes"),
        say("a", "3", "2", 3, "toolResult", "x"), say("a", "4", "1", 4, "assistant ", "branch"),
        say("a", "b1", "", 10, "user", "q"), say("a", "b2", "b1", 11, "user", "q"), say("a", "b3", "b2", 12, "assistant", "a"),
        say("a", "c1", "gone", 20, "user", "q foo_bar.ts"), say("a", "c2", "c1", 21, "assistant", "a"),
        say("a", "l1", "l2", 30, "user", "q"), say("a", "l2", "l1", 31, "assistant", "a"),
        say("a", "d1", None, 40, "user", "q"), say("a", "d2", "d1", 41, "???", "a"), say("a", "d3", "d2", 42, "assistant", "a"),
        say(None, "1", None, 1, "user", "hi foo_bar.ts"), say(None, "2", "1", None, "model", "there"),
        say("e", "1", None, 1, "user", " "), say("e", None, None, 2, "user", "q"),
    ]


@pytest.mark.parametrize("local_rows", [1000, 0])
def test_conversations(spark, local_rows):
    got = {tuple(r) for r in conversations.kept(spark.createDataFrame(talk_rows(), TALK), local_rows=local_rows).collect()}
    assert got == {("a", "r", 1, "1"), ("a", "r", 2, "4")}
    assert conversations.kept(spark.createDataFrame([], TALK), local_rows=local_rows).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_both_ways(spark, seed):
    r, rows = random.Random(seed), []
    for s in "ab":
        for i in range(60):
            parent = None if r.random() < 0.2 or not i else f"{max(0, i - r.choice([1, 1, 1, 2]))}" if r.random() < 0.95 else "no"
            rows.append(say(s, str(i), parent, i, ["user", "assistant"][i % 2] if r.random() < 0.9 else r.choice(["user", "toolResult", "?"]), "t"))
    df = spark.createDataFrame(rows, TALK)
    one, two = ({tuple(x) for x in conversations.kept(df, local_rows=n).collect()} for n in (1000, 0))
    assert one == two and one


def test_inferred_links_join_conversations(spark):
    rows = [say("a", "1", None, 1, "user", "see foo_bar.ts"), say("a", "2", "1", 2, "assistant", "done"), say("a", "4", "3", 4, "user", "more"), say("a", "5", "4", 5, "assistant", "done")]
    df = spark.createDataFrame(rows, TALK)
    assert conversations.kept(df).count() == 2
    assert [r.entry_id for r in conversations.kept(df, least=0.3).orderBy("turn_no").collect()] == ["1", "2", "4", "5"]


@pytest.mark.parametrize("local_rows", [1000, 0])
def test_named_links_need_no_scores(spark, monkeypatch, local_rows):
    """Links that only names can make are followed without features or scores; where scores decide they are made."""
    df = spark.createDataFrame(talk_rows(), TALK)
    rows = conversations.coded(df).toPandas().assign(source_id=lambda x: x["source_id"].fillna(""))
    last = conversations.latest(rows)
    parent, score = conversations.best_links(last)
    assert [p if s >= conversations.NAMED else -1 for p, s in zip(parent, score, strict=True)] == conversations.named_links(last).tolist()
    assert conversations.MOST_INFERRED == conversations.link_score(0, conversations.MENTIONS, 1.0) < conversations.NAMED == conversations.link_score(None, 0, 0.0, named=True)

    def no_score(*_):
        raise AssertionError("a link is scored")

    assert "mentions" in conversations.kept(df, least=0.3)._jdf.queryExecution().analyzed().toString()
    for name in ("best_links", "chosen_large"):
        monkeypatch.setattr(conversations, name, no_score)
    assert len(conversations.solve(rows.drop(columns=["mentions", "words"]), conversations.NAMED)) == 2
    got = conversations.kept(df, local_rows=local_rows)
    assert "mentions" not in got._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in got.collect()} == {("a", "r", 1, "1"), ("a", "r", 2, "4")}


def test_likely_parents(spark):
    got = {r.entry_id: (r.likely_parent_id, r.score) for r in conversations.likely_parents(spark.createDataFrame(talk_rows(), TALK)).collect()}
    assert got == {"c1": ("b3", conversations.link_score(8000, 0, 0.0))}
    assert kind_of("message", None) == conversations.BROKEN and kind_of("label", None) == conversations.PLAIN


def test_leakage_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([10, 15, 40])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(80):
        w = r.choices(vocabulary, k=50)
        if d % 3 == 0:
            source = words(r.choice(items[:30])[1])
            k = r.randrange(max(1, len(source) - 15))
            w[10:10] = source[k : k + r.choice([14, 15, 16])]
        docs.append((d, "<b>" + r.choice([" ", ", ", " <br> ", "\r\n> "]).join(w), 7))
    docs += [docs[0], (500, None, 1), (501, "", 1), (None, "x", 1)]

    def runs(t):
        t = leakage.MARKUP.sub(" ", t)
        w = words(t)
        return {tuple(w[k : k + 15]) for k in range(len(w) - 14)}

    want = {(d, i) for d, t, _ in docs if d is not None and t for i, x in items if x and runs(t) & runs(x)}
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x) for x in leakage.leaked(table, tests).collect()} == want and want
    assert {tuple(x)[:2] for x in leakage.overlaps(table, tests, index_words=300).collect()} == want
    assert leakage.leaked(table.limit(0), tests).count() == 0
    assert leakage.leaked(table, tests.limit(0)).count() == 0


def test_overlap_of_question_and_answer(spark):
    ask, say = " ".join(f"ask{i}" for i in range(30)), " ".join(f"say{i}" for i in range(20))
    tests = spark.createDataFrame([(1, f"{ask}\nAnswer: {say}"), (2, "too short")], "item_id long, text string")
    docs = [(1, f"{ask}\n<b>Answer</b>: {say}!"), (2, f"x {ask}"), (3, "y " + say), (4, " ".join(ask.split()[5:20])), (5, " ".join(ask.split()[5:19]))]
    got = {tuple(r) for r in leakage.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), tests).collect()}
    assert got == {(1, 1, 30, 20, True), (2, 1, 30, 0, False), (3, 1, 0, 20, False), (4, 1, 15, 0, False)}
    report = {r.item_id: r.leaking_docs for r in leakage.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), tests.selectExpr("*", "'t' as task")).collect()}
    assert report == {1: 4, 2: None}


def test_index_of_many_items():
    """20,000 items in one index: its size goes with the lists, and it finds what stands in a text."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(r.choices(vocabulary, k=40))) for k in range(20_000)]
    index = leakage.Index(items)
    assert sum(x.nbytes for x in (index.keys, index.weights, index.block_keys, index.block_max)) < 30 * 20_000 * 40
    taken = r.sample(range(20_000), 40)
    texts = [" ".join(r.choices(vocabulary, k=60) + words(items[k][1])[3:18] + r.choices(vocabulary, k=60)) for k in taken]
    assert {(t, int(index.ids[j])) for t, j in index.leaks(texts)} == set(enumerate(taken))


def near_rows(seed=5):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a"] * 20 + [f"word{i}" for i in range(300)]
    base = [r.choices(vocabulary, k=r.randrange(30, 80)) for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(200):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            r.shuffle(w)
        rows.append((1000 + k, (" ".join(w)).title() if r.random() < 0.3 else ", ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, "short"), (None, rows[0][1]), (5003, "!" * 100), rows[0]]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    table = spark.createDataFrame([(*x, 1) for x in rows], "segment_id long, text string, rep int")
    want = near_duplicates.brute_force({k: t for k, t in rows if k is not None})
    got = {tuple(x) for x in near_duplicates.pairs(table, node_rows=16).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 50
    assert near_duplicates.pairs(table.limit(0)).count() == 0


def test_near_duplicates_in_one_large_cluster(spark):
    """A third of all rows are edits of one text: nodes that never shrink are compared block by block."""
    r = random.Random(9)
    base = [f"word{i}" for i in range(60)]
    rows = []
    for k in range(330):
        w = list(base)
        w[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(r.choices([f"v{i}" for i in range(900)], k=40))) for k in range(660)]
    table = spark.createDataFrame(rows, "segment_id long, text string")
    got = {tuple(x) for x in near_duplicates.pairs(table, node_rows=64, most_steps=1).collect()}
    assert {p for p in got if p[1] < 1000} == {(a, b) for a in range(330) for b in range(a + 1, 330)}


def test_copies_beyond_the_bound_keep_their_class(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(k, text) for k in range(12)] + [(50, text.replace("word0 ", "other ")), (51, text.replace("word0 ", "third "))]
    got = {tuple(x) for x in near_duplicates.pairs(spark.createDataFrame(rows, "segment_id long, text string"), most_copies=5).collect()}
    assert got == {(0, k) for k in range(1, 12)} | {(0, 50), (0, 51), (50, 51)}


def test_reordered_texts_beyond_the_bound_are_all_paired(spark):
    """Texts of the same words in another order, case or punctuation are no identical copies: no group size takes their pairs away."""
    r = random.Random(4)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for k in range(70):
        w = list(base)
        r.shuffle(w)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(["other", *base[1:]])) for k in range(2)] + [(200 + k, ", ".join(base).title()) for k in range(70)]
    got = {tuple(x) for x in near_duplicates.pairs(spark.createDataFrame(rows, "segment_id long, text string")).collect()}
    want = near_duplicates.brute_force(dict(rows))
    assert got == {p for p in want if not p[1] > 200} | {(200, k) for k in range(201, 270)}


def test_groups_have_one_form_for_any_size(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(k, text) for k in range(100)] + [(200, text.replace("word0 ", "other ")), (300, " ".join(f"else{i}" for i in range(40))), (301, "short"), (None, text), (302, None)]
    got = {r.segment_id: tuple(r)[1:] for r in near_duplicates.grouped(spark.createDataFrame(rows, "segment_id long, text string")).collect()}
    assert got == {k: (0, 100, 100, 0) for k in range(100)} | {200: (200, 1, 100, 0), 300: (300, 1, 0, 300)}
    assert near_duplicates.grouped(spark.createDataFrame([], "segment_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=40), st.lists(st.sampled_from("abcdefgh"), max_size=40))
def test_parity_maps_lose_no_similar_pair(x, y):
    bags = near_duplicates.Bags([" ".join(x), " ".join(y)], near_duplicates.WordHashes())
    size, maps = bags.size.astype("int32"), bags.maps().view("uint64")
    i, _ = near_duplicates.alike(size[:1], maps[:1], size[1:], maps[1:], Fraction(4, 5))
    shared = (Counter(x) & Counter(y)).total()
    assert len(i) or 5 * shared < 4 * max(len(x), len(y))


def test_similarity_is_exact():
    a = " ".join(f"w{i}" for i in range(50))
    assert near_duplicates.brute_force({1: a, 2: " ".join(f"w{i}" for i in range(10, 60))}) == {(1, 2)}
    assert near_duplicates.brute_force({1: a, 2: " ".join(f"w{i}" for i in range(11, 61))}) == set()
    assert near_duplicates.SIMILARITY == Fraction(4, 5)


def mix_tables(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["big"] * 6 + ["Small ", "mid-dle"]), " ".join(["token"] * r.randrange(5, 60))) for i in range(600)]
    docs += [(9000, None, "left out of plans"), (9001, "big", None), (9002, "big", ""), (9003, "big", docs[0][2])]
    targets = [("p", "big", 0.5, None, 0.5), ("p", "small", 0.3, 3, 0.5), ("p", "mid_dle", 0.2, 1, 0.5), ("p", "none", 0.1, 2, 0.5), (None, "big", 1.0, 1, 1.0), ("p", None, 1.0, 1, 1.0), ("q", "small", 1.0, 2, 5.0)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, "plan_id string, source string, target_share double, max_repeats int, size_factor double")


def test_mixing(spark):
    docs, targets = mix_tables(spark)
    solved = mixing.Mix(docs, targets)
    rows = solved.copies().collect()
    reached = {(r.plan_id, r.source): r for r in solved.shares().collect()}
    assert all(r.copies <= {"small": 3 if r.plan_id == "p" else 2, "mid_dle": 1, "big": 10**9}[r.source] for r in rows)
    for k in (("p", "big"), ("p", "small"), ("p", "mid_dle")):
        assert reached[k].tokens == pytest.approx(reached[k].goal_tokens, abs=4)
    assert reached["p", "none"].tokens == 0 and reached["p", "none"].at_limit
    small = docs.filter("source = 'Small '").count()
    assert sum(r.copies for r in rows if r.plan_id == "q") == 2 * small and reached["q", "small"].actual_share == 1.0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_mixing_balances_tokens_and_mean_length(spark):
    """Copies lower the prior of long documents and a cap binds: tokens and mean length still hold."""
    r = random.Random(2)
    docs = [(k, "s", " ".join(f"t{k}x" for _ in range(r.randrange(3, 90)))) for k in range(300)]
    docs += [(1000 + k, "s", docs[k % 20][2]) for k in range(100)]
    solved = mixing.Mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("p", "s", 1.0, 2, 1.3)], "plan_id string, source string, target_share double, max_repeats int, size_factor double"))
    (goal,) = solved.goals
    rows = solved.docs.toPandas()
    rate = mixing.rates(goal, rows["n_tokens"].to_numpy(), rows["copies"].to_numpy()) / mixing.UNIT
    assert (rate * rows["n_tokens"]).sum() == pytest.approx(goal["goal"], rel=1e-5) and rate.sum() == pytest.approx(goal["goal"] / goal["mean"], rel=1e-5)
    assert rate.max() < 2 and goal["b"] != 0.0
    (check,) = solved.checks().collect()
    assert check.cap_kept and check.goal_met


def test_rounding_leaves_half_the_shortest_document():
    r = random.Random(3)
    tokens = np.array(sorted((r.randrange(1, 500) for _ in range(400)), reverse=True))
    rate = np.array([r.randrange(0, 2 * mixing.UNIT) for _ in tokens])
    copies = mixing.rounded(tokens, rate, None)
    assert abs((copies * tokens).sum() - (rate * tokens / mixing.UNIT).sum()) <= tokens[-1] / 2 + 1e-6


def test_mixing_goals_keep_the_size():
    goals = mixing.fill(
        [{"plan_id": "p", "source": s, "target_share": 0.5, "max_repeats": m, "size_factor": 1.0} for s, m in (("a", 1), ("b", None))], {"a": 10, "b": 90}, 100
    )
    assert [(g["source"], g["goal"]) for g in goals] == [("a", 10.0), ("b", 90.0)]


def test_reading_levels(spark):
    r = random.Random(2)
    easy, hard = [f"{c}at" for c in "bchmprs"] + ["the", "of"], [f"{p}isational" for p in ("organ", "character", "general", "optim", "util", "form", "vis")] + ["the", "of"]

    def text(level):
        pool, size = (easy, 5) if level == 1 else (hard, 30)
        return " ".join(" ".join(r.choices(pool, k=size)).capitalize() + "." for _ in range(8))

    docs = [(i, text(1 if i % 2 else 5), r.choice(["en", "EN", "en-US", None]), "a", i) for i in range(120)]
    docs += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "```\nx = 1\n```", "en", "a", 0), (903, "der Hund und die Katze. das ist nicht.", None, "a", 0), (904, text(5), "de", "a", 0)]
    grades = [(i, k, 1 if i % 2 else 5) for i in range(40) for k in (1, 2)] + [(0, 3, None), (5000, 1, 3)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, grade long")
    marks = spark.createDataFrame(grades, "doc_id long, rater_id int, grade int")
    assert {x[0] for x in reading.demanding(table, marks).collect()} == {i for i in range(0, 120, 2)}
    assert reading.demanding(table.limit(0), marks).count() == 0
    with pytest.raises(ValueError):
        reading.levels(table, marks.limit(0))
