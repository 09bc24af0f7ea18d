"""Parent-child rows to full hierarchies, by heavy-path decomposition.

Every tree is cut into chains: from each entry the child with the largest
subtree continues its chain, every other child heads a new one.  A path from
any entry to its root then crosses at most log2(n) chains, so

* the path of an entry is the list of (chain, last position) segments,
* its descendants are one interval of ``pre_order``,

and neither needs a row per ancestor.  Sources of up to ``local_rows`` rows are
solved whole inside one task with vectorised pointer doubling; larger ones by
the DataFrame rounds of :mod:`loomline.operators.forest`.  Both give the same
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.forest import climb, loop_minimum, prefix_offsets, split_by_size
from loomline.runtime import Spool

#: Rows of one source that a single task may hold (about 50 MB of Python strings).
LOCAL_ROWS = 200_000
#: Rows gathered before a task solves the whole sources it has.
FLUSH_ROWS = 100_000

SCHEMA = (
    "source_id string, entry_id string, parent_id string, root_id string, node_depth long, "
    "chain_id string, chain_pos long, subtree_size long, pre_order long, path array<struct<chain_id:string,upto:long>>"
)


def double(ptr: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last index reached, sum of ``add`` over the path) for acyclic pointers; -1 ends a path."""
    top, total, jump = np.arange(len(ptr)), add.astype(np.int64), ptr.copy()
    while True:
        at = np.flatnonzero(jump >= 0)
        if not len(at):
            return top, total
        to = jump[at]
        gained, reached, onward = total[to], top[to], jump[to]
        total[at] += gained
        top[at] = reached
        jump[at] = onward


def close_loops(ptr: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(on or below a loop, index of the loop's entry of least rank) for any pointers."""
    n, jump = len(ptr), ptr.copy()
    least, steps = rank.copy(), 1
    while steps <= n and (jump >= 0).any():
        at = np.flatnonzero(jump >= 0)
        to = jump[at]
        smaller, onward = np.minimum(least[at], least[to]), jump[to]
        least[at] = smaller
        jump[at] = onward
        steps *= 2
    looped = jump >= 0
    by_rank = np.empty(n, dtype=np.int64)
    by_rank[rank] = np.arange(n)
    loop = np.full(n, -1)
    loop[looped] = by_rank[least[jump[looped]]]
    return looped, loop


def subtree_sizes(ptr: np.ndarray) -> np.ndarray:
    """Rows in each subtree; a pass doubles the depth below that is counted."""
    size, jump = np.ones(len(ptr), dtype=np.int64), ptr.copy()
    while True:
        at = np.flatnonzero(jump >= 0)
        if not len(at):
            return size
        size = size + np.bincount(jump[at], weights=size[at], minlength=len(ptr)).astype(np.int64)
        onward = jump[jump[at]]
        jump[at] = onward


def solve(source: np.ndarray, entry: np.ndarray, parent: np.ndarray, line: np.ndarray, with_path: bool) -> pd.DataFrame:
    """The hierarchy rows of whole sources held in memory."""
    rows = pd.DataFrame({"source": source, "entry": entry, "parent": parent, "line": line})
    rows["parent"] = rows["parent"].fillna("")
    rows = rows.sort_values(["source", "entry", "line", "parent"]).drop_duplicates(["source", "entry"], keep="last").reset_index(drop=True)
    n = len(rows)
    place = pd.MultiIndex.from_arrays([rows["source"], rows["entry"]])
    ptr = place.get_indexer(pd.MultiIndex.from_arrays([rows["source"], rows["parent"]])).astype(np.int64)
    ptr[(rows["parent"] == "").to_numpy()] = -1
    rank = np.arange(n)  # rows stand in the order of (source, entry)
    looped, loop = close_loops(ptr, rank)
    tree = np.where(looped, -1, ptr)
    size = subtree_sizes(tree)

    kids = np.flatnonzero(tree >= 0)
    order = kids[np.lexsort((kids, -size[kids], tree[kids]))]
    first = np.ones(len(order), dtype=bool)
    first[1:] = tree[order[1:]] != tree[order[:-1]]
    heavy = np.zeros(n, dtype=bool)
    heavy[order[first]] = True
    sums = np.cumsum(size[order]) - size[order]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    step = np.zeros(n, dtype=np.int64)
    step[order] = 1 + sums - sums[begin] if len(order) else 0

    head, pos = double(np.where(heavy, tree, -1), heavy)
    heads = np.flatnonzero(~heavy)
    number = np.full(n, -1)
    number[heads] = np.arange(len(heads))
    up = tree[heads]
    chain_ptr = np.where(up >= 0, number[head[up]], -1)
    _, base = double(chain_ptr, np.where(up >= 0, pos[up] + 1, 0))
    top_chain, before = double(chain_ptr, np.where(up >= 0, pos[up] + step[heads], 0))
    mine = number[head]
    names = rows["entry"].to_numpy()
    known = np.where(ptr >= 0, names[ptr], None)
    out = pd.DataFrame(
        {
            "source_id": rows["source"],
            "entry_id": names,
            "parent_id": known,
            "root_id": np.where(looped, names[loop], names[heads[top_chain[mine]]]),
            "node_depth": np.where(looped, -1, base[mine] + pos),
            "chain_id": np.where(looped, None, names[head]),
            "chain_pos": pd.array(np.where(looped, 0, pos), dtype="Int64"),
            "subtree_size": pd.array(np.where(looped, 0, size), dtype="Int64"),
            "pre_order": pd.array(np.where(looped, 0, before[mine] + pos), dtype="Int64"),
        }
    )
    for c in ("chain_pos", "subtree_size", "pre_order"):
        out.loc[looped, c] = pd.NA
    if with_path:
        prefix: list = [None] * len(heads)
        for c in np.argsort(base, kind="stable"):
            p = chain_ptr[c]
            prefix[c] = [] if p < 0 else [*prefix[p], {"chain_id": names[heads[p]], "upto": int(pos[up[c]])}]
        out["path"] = [None if bad else [*prefix[c], {"chain_id": names[heads[c]], "upto": int(q)}] for bad, c, q in zip(looped, mine, pos, strict=True)]
    else:
        out["path"] = None
    return out


def in_task(with_path: bool, flush_rows: int = FLUSH_ROWS):
    """A mapInPandas function over rows sorted by source: solves whole sources, some at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def answer(part: pd.DataFrame) -> pd.DataFrame:
            null = part["source_id"].isna()
            keys = np.where(null, "", "s" + part["source_id"].fillna("").astype(str))
            out = solve(keys, part["entry_id"].to_numpy(), part["parent_id"].to_numpy(), part["line_index"].fillna(-1).to_numpy(), with_path)
            out["source_id"] = [None if k == "" else k[1:] for k in out["source_id"]]
            return out

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < flush_rows:
                continue
            rows = pd.concat(held, ignore_index=True)
            key = rows["source_id"].fillna("\0")
            rest = key == key.iloc[-1]
            if not rest.all():
                yield answer(rows[~rest])
            held = [rows[rest]]
        if held:
            yield answer(pd.concat(held, ignore_index=True))

    return run


def solve_large(spark: SparkSession, rows: DataFrame, with_path: bool) -> DataFrame:
    """The hierarchy rows of sources that no task may hold, in DataFrame rounds."""
    last = rows.groupBy("source_id", "entry_id").agg(F.max(F.struct(F.coalesce("line_index", F.lit(-1)).alias("line"), F.coalesce("parent_id", F.lit("")).alias("parent"))).alias("l"))
    names = Spool(last.select(F.monotonically_increasing_id().alias("node"), "source_id", "entry_id", F.col("l.parent").alias("parent_id")), "names").df
    over = names.select(F.col("node").alias("ptr"), F.col("source_id").alias("_s"), F.col("entry_id").alias("_e"))
    nodes = Spool(
        names.join(over, (F.col("parent_id") != "") & F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("parent_id") == F.col("_e")), "left")
        .select("node", "ptr", "source_id", "entry_id"),
        "nodes",
    ).df
    sized = climb(nodes.select("node", "ptr", F.lit(1).cast("long").alias("size")), sub_sums=("size",)).df
    looped = sized.filter("jump is not null").select("node")
    bad = loop_minimum(nodes.join(looped, "node", "left_semi").select("node", "ptr", F.col("entry_id").alias("label")))

    tree = Spool(
        nodes.select("node", F.col("ptr").alias("up")).join(sized.filter("jump is null").select("node", "size"), "node"), "tree"
    ).df
    heir = tree.filter("up is not null").groupBy("up").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("heir"))
    marked = Spool(
        tree.join(heir, "up", "left").select("node", "up", "size", F.coalesce(F.col("heir") == F.col("node"), F.lit(False)).alias("heavy")), "marked"
    ).df
    chained = climb(marked.select("node", F.when(F.col("heavy"), F.col("up")).alias("ptr"))).df.select("node", F.col("top").alias("head"), F.col("hops").alias("pos"))
    light = prefix_offsets(marked.filter("up is not null and not heavy"), "up", [F.col("node")], "size", "node").select("node", "up", "offset")
    heavy_size = marked.filter("heavy").select("up", F.col("size").alias("heavy_size"))
    place = F.struct(F.col("_head").alias("head"), F.col("_pos").alias("pos"))
    chains = Spool(
        marked.filter("not heavy").select("node", "up")
        .join(chained.select(F.col("node").alias("up"), F.col("head").alias("_head"), F.col("pos").alias("_pos")), "up", "left")
        .join(light.join(heavy_size, "up").select("node", (F.col("offset") + F.col("heavy_size") + 1).alias("step")), "node", "left")
        .select(
            "node",
            F.col("_head").alias("ptr"),
            F.coalesce(F.col("_pos") + 1, F.lit(0)).alias("base"),
            F.coalesce(F.col("_pos") + F.col("step"), F.lit(0)).alias("before"),
            F.when(F.col("_head").isNull(), F.array().cast("array<struct<head:long,pos:long>>")).otherwise(F.array(place)).alias("prefix"),
        ),
        "chains",
    ).df
    based = climb(chains, sums=("base", "before"), chains=("prefix",)).df.select(F.col("node").alias("head"), "top", "base", "before", "prefix")
    label = nodes.select(F.col("node").alias("_n"), F.col("entry_id").alias("_name"))
    solved = (
        nodes.join(tree.select("node", "size"), "node").join(chained, "node").join(based, "head")
        .join(label.select(F.col("_n").alias("top"), F.col("_name").alias("root_id")), "top")
        .join(label.select(F.col("_n").alias("head"), F.col("_name").alias("chain_id")), "head")
        .join(label.select(F.col("_n").alias("ptr"), F.col("_name").alias("parent_name")), "ptr", "left")
    )
    if with_path:
        segments = (
            based.select("head", F.posexplode("prefix").alias("k", "s")).select("head", "k", F.col("s.head").alias("_n"), F.col("s.pos").alias("upto"))
            .join(label, "_n").groupBy("head")
            .agg(F.array_sort(F.collect_list(F.struct("k", F.col("_name").alias("chain_id"), "upto"))).alias("named"))
        )  # at most log2(n) segments a chain
        solved = solved.join(segments, "head", "left").withColumn(
            "path",
            F.concat(
                F.coalesce(F.transform("named", lambda s: F.struct(s["chain_id"].alias("chain_id"), s["upto"].alias("upto"))), F.array().cast("array<struct<chain_id:string,upto:long>>")),
                F.array(F.struct(F.col("chain_id"), F.col("pos").alias("upto"))),
            ),
        )
    else:
        solved = solved.withColumn("path", F.lit(None).cast("array<struct<chain_id:string,upto:long>>"))
    good = solved.select(
        "source_id", "entry_id", F.col("parent_name").alias("parent_id"), "root_id", (F.col("base") + F.col("pos")).alias("node_depth"),
        "chain_id", F.col("pos").alias("chain_pos"), F.col("size").alias("subtree_size"), (F.col("before") + F.col("pos")).alias("pre_order"), "path",
    )
    loops = (
        nodes.join(bad, "node").join(label.select(F.col("_n").alias("ptr"), F.col("_name").alias("parent_name")), "ptr", "left")
        .select("source_id", "entry_id", F.col("parent_name").alias("parent_id"), F.col("loop_label").alias("root_id"), F.lit(-1).cast("long").alias("node_depth"),
                F.lit(None).cast("string").alias("chain_id"), *(F.lit(None).cast("long").alias(c) for c in ("chain_pos", "subtree_size", "pre_order")),
                F.lit(None).cast("array<struct<chain_id:string,upto:long>>").alias("path"))
    )
    return good.unionByName(loops)


def hierarchy(records: DataFrame, with_path: bool = True, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row per entry: parent, root, depth, chain, subtree size, pre-order number and path segments.

    records: ``source_id``, ``entry_id``, ``parent_id``, ``line_index`` (other
    columns are ignored, whatever their names).  Rows whose ``entry_id`` is null
    or empty are no entries.  Of several rows of one entry that with the greatest
    ``line_index`` holds (null lowest; ties: the greater ``parent_id``), so exact
    repeats change nothing.  A null ``source_id`` is a source of its own.  A
    parent that is null, empty or not in the source makes a root.  Entries on or
    below a loop have depth -1, the loop's smallest ``entry_id`` as ``root_id``
    and null in the chain columns.  An empty input gives an empty result.
    """
    spark = records.sparkSession
    entries = records.select("source_id", "entry_id", "parent_id", F.col("line_index").cast("long").alias("line_index")).filter("entry_id is not null and entry_id <> ''")
    small, large = split_by_size(entries, "source_id", local_rows)
    solved = small.repartition(F.col("source_id")).sortWithinPartitions("source_id").mapInPandas(in_task(with_path), SCHEMA)
    if large.limit(1).count():
        solved = solved.unionByName(solve_large(spark, large, with_path))
    return solved


def _wanted(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the tree that are asked for; a null source is a source of its own."""
    asked = wanted.select(F.col("source_id").alias("_ws"), F.col("entry_id").alias("_we")).distinct()
    return tree.filter("node_depth >= 0").join(asked, F.col("source_id").eqNullSafe(F.col("_ws")) & (F.col("entry_id") == F.col("_we")), "left_semi")


def expand_paths(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per step of the paths of the wanted entries (``source_id``, ``entry_id``), root first.

    Joins path segments to chain positions; ``step`` counts from 0 at the root.
    Entries on or below loops have no path and no row.
    """
    part = _wanted(tree, wanted).select("source_id", "entry_id", F.explode("path").alias("_seg"))
    part = part.select("source_id", "entry_id", F.col("_seg.chain_id").alias("_chain"), F.col("_seg.upto").alias("_upto"))
    chain = tree.select(F.col("source_id").alias("_cs"), "chain_id", "chain_pos", F.col("entry_id").alias("ancestor_id"), F.col("node_depth").alias("step"))
    on_chain = F.col("source_id").eqNullSafe(F.col("_cs")) & (F.col("_chain") == F.col("chain_id")) & (F.col("chain_pos") <= F.col("_upto"))
    return part.join(chain, on_chain).select("source_id", "entry_id", "ancestor_id", "step")


def descendants(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per (wanted entry, descendant): all entries whose path passes the wanted entry's chain at its place or below.

    Joined by chain, so an entry meets only the entries wanted on the at most
    log2(n) chains of its own path.  Entries on or below loops have no row.
    """
    top = _wanted(tree, wanted).select(F.col("source_id").alias("_ts"), F.col("entry_id").alias("_te"), F.col("chain_id").alias("_tc"), F.col("chain_pos").alias("_tp"))
    below = tree.select("source_id", F.col("entry_id").alias("descendant_id"), F.explode("path").alias("_seg"))
    passes = F.col("source_id").eqNullSafe(F.col("_ts")) & (F.col("_seg.chain_id") == F.col("_tc")) & (F.col("_seg.upto") >= F.col("_tp")) & (F.col("descendant_id") != F.col("_te"))
    return below.join(top, passes).select("source_id", F.col("_te").alias("entry_id"), "descendant_id")
