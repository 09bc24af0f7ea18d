import random

import pytest

from loomline.operators.forest import components
from loomline.operators.hierarchy import descendants, expand_paths, hierarchy

FIELDS = "source_id string, entry_id string, parent_id string, line_index long, root_id int, chain_id int"


def brute(rows):
    held = {}
    for s, e, p, line, *_ in sorted(rows, key=lambda r: (-1 if r[3] is None else r[3], r[2] or "")):
        if e:
            held[s, e] = p or None
    held = {k: (p if (k[0], p) in held else None) for k, p in held.items()}
    out = {}
    for s, e in held:
        path, at = [e], e
        while (at := held[s, at]) is not None and at not in path:
            path.append(at)
        out[s, e] = (path[-1], len(path) - 1, path) if at is None else (min(path[path.index(at) :]), -1, None)
    return out


def sample(seed):
    r, rows = random.Random(seed), []
    for s in ("a", "b", None, "c"):
        n = 40 if s != "c" else 3
        for i in range(n):
            up = f"e{r.randrange(n)}" if r.random() < 0.15 else f"e{max(0, i - r.choice([1, 1, 1, 2, 5]))}"
            rows.append((s, f"e{i}", r.choice([None, ""]) if i == 0 or r.random() < 0.05 else up, i if r.random() > 0.05 else None, 1, 2))
        rows += [rows[-1], (s, None, "e1", 3, 1, 2), (s, "", "e1", 4, 1, 2), (s, "e2", "gone", 99, None, None)]
    rows += [("d", f"k{i}", f"k{i - 1}" if i else None, i, 1, 1) for i in range(70)]
    rows += [("s", f"k{i}", "k0" if i else None, i, 1, 1) for i in range(50)]
    return rows


@pytest.mark.parametrize("local_rows", [10_000, 45])
def test_against_brute_force(spark, local_rows):
    rows = sample(local_rows)
    tree = hierarchy(spark.createDataFrame(rows, FIELDS), local_rows=local_rows).cache()
    want, got = brute(rows), tree.collect()
    assert {(r.source_id, r.entry_id): (r.root_id, r.node_depth) for r in got} == {k: v[:2] for k, v in want.items()}
    assert len(got) == len(want)
    by_chain = {(r.source_id, r.chain_id, r.chain_pos): r.entry_id for r in got if r.chain_id}
    for r in got:
        path = want[r.source_id, r.entry_id][2]
        if path is None:
            assert r.path is None and r.pre_order is None
            continue
        walked = [by_chain[r.source_id, s.chain_id, k] for s in r.path for k in range(s.upto + 1)]
        assert walked == path[::-1]
        assert len(r.path) <= 7
    keys = tree.select("source_id", "entry_id")
    under = {(r.source_id, r.entry_id, r.descendant_id) for r in descendants(tree, keys).collect()}
    assert under == {(s, a, e) for (s, e), (_, _, path) in want.items() if path for a in path[1:]}
    steps = {(r.source_id, r.entry_id, r.step, r.ancestor_id) for r in expand_paths(tree, keys).collect()}
    assert steps == {(s, e, k, a) for (s, e), (_, _, path) in want.items() if path for k, a in enumerate(path[::-1])}


@pytest.mark.parametrize("local_rows", [10_000, 0])
def test_empty_and_only_loops(spark, local_rows):
    assert hierarchy(spark.createDataFrame([], FIELDS), local_rows=local_rows).count() == 0
    got = hierarchy(spark.createDataFrame([("a", "x", "y", 1, 0, 0), ("a", "y", "x", 2, 0, 0), ("a", "z", "z", 3, 0, 0)], FIELDS), local_rows=local_rows)
    assert sorted((r.entry_id, r.root_id, r.node_depth) for r in got.collect()) == [("x", "x", -1), ("y", "x", -1), ("z", "z", -1)]


def test_components_against_union_find(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5000 + k, 5001 + k) for k in range(60)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, top(x)) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
