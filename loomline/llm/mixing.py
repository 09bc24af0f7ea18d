"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r >= 0, no more than its cap R, such that the documents
of a source give its tokens and keep their mean length:

    sum of r * tokens = goal,    sum of r = goal / mean tokens of the source.

Of all such rates those closest in relative entropy to the prior q are taken.
The dual is convex with two multipliers (a, b) per plan and source, and the rates
are exponentially tilted priors,

    r = q * exp(z)                          without cap,
    r = R / (1 + (R / q - 1) * exp(-z))     with cap (bounded entropy),

with z = a + b * tokens / mean tokens, so no cap is ever exceeded.  The second
constraint keeps the tilt from filling a goal with the longest or shortest
documents alone; equal rates meet both, so every goal within the cap has a
solution.  The prior is 1 over the number of exact copies of a text: copies
together count once.  Newton's method solves the dual; each step is one
aggregation over the (source, copies, tokens) histogram for all plans at once.

Rates become whole copies from the longest document to the shortest, carrying on
the tokens that rounding has left over, so that the tokens reached differ from
the goal by about half the shortest document.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import Spool

#: Plans are driver-side parameters; a larger table of targets is refused.
MOST_TARGETS = 100_000
#: Rates are rounded to whole billionths, so that copies do not depend on the order of sums.
UNIT = 1_000_000_000
#: Newton stops when every constraint is met this closely, relatively; it is an error if that many steps do not suffice.
TOLERANCE = 1e-7
MOST_STEPS = 200
#: Documents of a source that are rounded together, in one task.
TOGETHER = 100_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def same_source(column: str):
    """A source name in uniform spelling: lower case, trimmed, with underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "[- ]+", "_")


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``text_hash`` of each document, tokens as counted by the vocabulary file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield b.assign(n_tokens=np.fromiter((len(encode(t)) for t in b["text"]), dtype=np.int64, count=len(b))).drop(columns=["text"])

    wanted = documents.select("doc_id", same_source("source").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = wanted.filter("doc_id is not null").select("doc_id", "source", F.xxhash64("text", F.length("text")).alias("text_hash"), "text")
    return hashed.mapInPandas(run, "doc_id long, source string, text_hash long, n_tokens long")


def fill(targets: list[dict], available: dict[str, int], corpus: int) -> list[dict]:
    """Each target with its ``goal`` in tokens.

    Shares are taken relative to their sum in the plan.  A source that cannot
    reach its share within its cap is drawn up to the cap; what it lacks goes to
    the other sources in proportion to their shares, so that the mix keeps its
    size as long as any source can still grow.
    """
    out = []
    for plan in sorted({t["plan_id"] for t in targets}):
        mine = [dict(t) for t in targets if t["plan_id"] == plan]
        total = sum(t["target_share"] for t in mine)
        size = max(t["size_factor"] for t in mine) * corpus
        for t in mine:
            tokens = available.get(t["source"], 0)
            t["limit"] = tokens * (math.inf if t["max_repeats"] is None else t["max_repeats"]) if tokens else 0
            t["share"] = t["target_share"] / total if total else 0.0
            t["goal"] = None
        left, free = size, mine
        while free:
            weight = sum(t["share"] for t in free)
            full = [t for t in free if not weight or t["limit"] <= left * t["share"] / weight]
            if not full:
                for t in free:
                    t["goal"] = left * t["share"] / weight
                break
            for t in full:
                t["goal"] = float(t["limit"]) if math.isfinite(t["limit"]) else 0.0
            left -= sum(t["goal"] for t in full)
            free = [t for t in free if t["goal"] is None]
        out += mine
    return out


def solve(histogram: DataFrame, goals: list[dict]) -> list[dict]:
    """The multipliers ``a`` and ``b`` of every (plan, source), by damped Newton steps on the dual.

    histogram: ``source``, ``copies``, ``n_tokens``, ``docs``.  A source drawn up
    to its cap needs no multiplier: its documents all get the cap.  A step that
    does not lower the dual is halved.
    """
    spark = histogram.sparkSession
    open_goals = {(g["plan_id"], g["source"]): g for g in goals if g["goal"] and g["goal"] < g["limit"] * (1 - 1e-9)}
    state = {k: (math.log(g["goal"] / g["tokens"]), 0.0) for k, g in open_goals.items()}
    before: dict = {}
    schema = "plan_id string, source string, cap double, mean double, a double, b double"
    q, cap, x, z, r = F.lit(1.0) / F.col("copies"), F.col("cap"), F.col("n_tokens") / F.col("mean"), F.col("z"), F.col("r")
    odds = F.exp(z) / (cap / F.least(q, cap * F.lit(0.5)) - 1)
    rate = F.when(cap.isNull(), q * F.exp(z)).otherwise(cap * odds / (1 + odds))
    potential = F.when(cap.isNull(), r).otherwise(cap * F.log1p(odds))
    slope = F.when(cap.isNull(), r).otherwise(r * (1 - r / cap)) * F.col("docs")
    left = set(state)
    for _ in range(MOST_STEPS):
        if not left:
            break
        rows = [(*k, None if open_goals[k]["max_repeats"] is None else float(open_goals[k]["max_repeats"]), open_goals[k]["mean"], *state[k]) for k in left]
        at = histogram.join(F.broadcast(spark.createDataFrame(rows, schema)), "source").withColumn("z", F.col("a") + F.col("b") * x).withColumn("r", rate)
        sums = at.groupBy("plan_id", "source").agg(
            F.sum(potential * F.col("docs")).alias("p"), F.sum(r * F.col("docs")).alias("g0"), F.sum(r * x * F.col("docs")).alias("g1"),
            F.sum(slope).alias("h0"), F.sum(slope * x).alias("h1"), F.sum(slope * x * x).alias("h2"),
        ).collect()
        for s in sums:
            k = s["plan_id"], s["source"]
            want = open_goals[k]["goal"] / open_goals[k]["mean"]
            a, b = state[k]
            dual = s["p"] - want * (a + b)
            miss = np.array([s["g0"] - want, s["g1"] - want])
            if np.abs(miss).max() <= TOLERANCE * want:
                left.discard(k)
                continue
            if k in before and not dual <= before[k][2] + 1e-12 * abs(before[k][2]):  # too far: half way back
                state[k] = (a + before[k][0]) / 2, (b + before[k][1]) / 2
                continue
            move = np.linalg.lstsq(np.array([[s["h0"], s["h1"]], [s["h1"], s["h2"]]]), miss, rcond=1e-12)[0]
            move *= min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
            before[k] = a, b, dual
            state[k] = a - float(move[0]), b - float(move[1])
    if left:
        raise ArithmeticError(f"the rates of {sorted(left)[:3]} did not settle in {MOST_STEPS} steps")
    return [g | dict(zip("ab", state.get((g["plan_id"], g["source"]), (None, None)), strict=True)) for g in goals]


def rates(goal: dict, tokens: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The rate of each document of a source, in billionths."""
    most = goal["max_repeats"]
    if goal["a"] is None:
        return np.full(len(tokens), int(most) * UNIT if most is not None else 0, dtype=np.int64)
    z, prior = goal["a"] + goal["b"] * tokens / goal["mean"], 1.0 / copies
    if most is None:
        return np.rint(prior * np.exp(z) * UNIT).astype(np.int64)
    odds = np.exp(z) / (most / np.minimum(prior, most * 0.5) - 1)
    return np.rint(most * odds / (1 + odds) * UNIT).astype(np.int64)


def rounded(tokens: np.ndarray, rate: np.ndarray, most: int | None) -> np.ndarray:
    """Whole copies of documents in descending order of tokens: what one leaves over or takes too much, the next make up for."""
    out, carry = np.zeros(len(tokens), dtype=np.int64), 0
    for k, (n, r) in enumerate(zip(tokens.tolist(), rate.tolist(), strict=True)):
        if n:
            carry += n * r
            c = max(0, (2 * carry + n * UNIT) // (2 * n * UNIT))
        else:
            c = (2 * r + UNIT) // (2 * UNIT)
        c = c if most is None else min(c, most)
        carry -= c * n * UNIT
        out[k] = c
    return out


def plan_rows(targets: DataFrame) -> list[dict]:
    """The targets with uniform source names; nulls in plan, source or share are no targets; a source named twice adds up, and its least cap holds."""
    kept = targets.filter("plan_id is not null and source is not null and target_share > 0").groupBy("plan_id", same_source("source").alias("source"))
    rows = kept.agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"), F.max(F.coalesce("size_factor", F.lit(1.0))).alias("size_factor")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [r.asDict() for r in rows]


class Mix:
    """The solved mix: ``copies`` (one row per drawn document and plan) and ``shares`` (one row per target)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str | None = None):
        self.spark = documents.sparkSession
        counted = Spool(token_counts(documents, vocabulary or tokenizer_path()), "tokens").df
        copies = counted.groupBy("text_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
        known = counted.join(copies, "text_hash", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        self.docs = Spool(known.select("doc_id", "source", "n_tokens", "copies"), "sized").df
        histogram = Spool(self.docs.groupBy("source", "copies", "n_tokens").agg(F.count("*").alias("docs")), "hist").df
        sums = histogram.groupBy("source").agg(F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens"), F.sum("docs").alias("docs"))
        corpus = sums.agg(F.sum("tokens")).first()[0] or 0
        rows = plan_rows(targets)
        named = sorted({r["source"] for r in rows})
        held = {r["source"]: r for r in sums.filter(F.col("source").isin(named)).collect()} if named else {}
        goals = fill(rows, {s: r["tokens"] for s, r in held.items()}, corpus)
        for g in goals:
            r = held.get(g["source"])
            g |= {"tokens": r["tokens"] if r else 0, "docs": r["docs"] if r else 0}
            g["mean"] = g["tokens"] / g["docs"] if g["docs"] else 0.0
        self.goals = solve(histogram, goals)
        self.table = self.spark.createDataFrame(
            [(g["plan_id"], g["source"], g["target_share"], g["share"], g["max_repeats"], float(g["goal"] or 0.0), float(g["limit"]), int(g["tokens"]), g["a"] is None) for g in self.goals],
            "plan_id string, source string, target_share double, share double, max_repeats long, goal double, limit double, available long, at_limit boolean",
        )

    def copies(self) -> DataFrame:
        """``plan_id``, ``source``, ``doc_id``, ``n_tokens``, ``copies``: every document drawn at least once.

        The documents of a source are spread over parts of about ``TOGETHER``,
        each rounded in one task for all plans.
        """
        drawn: dict[str, list[dict]] = {}
        for g in self.goals:
            if g["goal"]:
                drawn.setdefault(g["source"], []).append(g)
        parts = self.spark.createDataFrame([(s, max(1, round(g[0]["docs"] / TOGETHER))) for s, g in drawn.items()], "source string, parts int")
        schema = "plan_id string, source string, doc_id long, n_tokens long, copies long"

        def draw(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
            tokens, copies, out = rows["n_tokens"].to_numpy(), rows["copies"].to_numpy(), []
            for g in drawn[rows["source"].iloc[0]]:
                taken = rounded(tokens, rates(g, tokens, copies), g["max_repeats"])
                out.append(rows[["source", "doc_id", "n_tokens"]].assign(plan_id=g["plan_id"], copies=taken)[taken > 0])
            return pd.concat(out)[["plan_id", "source", "doc_id", "n_tokens", "copies"]]

        placed = self.docs.join(F.broadcast(parts), "source").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        return placed.select("source", "part", "doc_id", "n_tokens", "copies").groupBy("source", "part").applyInPandas(draw, schema)

    def shares(self) -> DataFrame:
        """Target and reached share of every source of every plan, in tokens."""
        reached = self.copies().groupBy("plan_id", "source").agg(
            F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies")
        )
        whole = Window.partitionBy("plan_id")  # the rows of one plan
        found = self.table.join(reached, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        share = F.when(F.sum("tokens").over(whole) > 0, F.col("tokens") / F.sum("tokens").over(whole)).otherwise(0.0)
        return found.select(
            "plan_id", "source", "target_share", F.col("available").alias("source_tokens"), F.round("goal").cast("long").alias("goal_tokens"), "tokens",
            F.round(share, 6).alias("actual_share"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "at_limit",
        )

    def checks(self, near: float = 0.01) -> DataFrame:
        """Per target whether its cap was kept and its goal met to ``near``: one row per target, for testing a mix.

        A source drawn up to its cap must give all its tokens that often; one
        without documents gives none.
        """
        got = self.shares().join(self.table.select("plan_id", "source", "max_repeats", "limit", "share"), ["plan_id", "source"])
        return got.select(
            "plan_id", "source", F.round("share", 6).alias("wanted_share"), (F.col("max_repeats").isNull() | (F.col("most_copies") <= F.col("max_repeats"))).alias("cap_kept"),
            F.when(F.col("at_limit"), F.col("tokens") == F.col("goal_tokens")).otherwise(F.abs(F.col("tokens") - F.col("goal_tokens")) <= F.col("goal_tokens") * near).alias("goal_met"),
            (F.col("source_tokens") > 0).alias("has_documents"),
        )


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Documents with their number of copies for each plan; see ``Mix``.

    A null source belongs to no plan but counts in the size of the corpus; null
    or empty texts have no tokens and are drawn like others of their size; rows
    of one ``doc_id`` are drawn separately; unknown sources give no row and show
    in ``shares`` with 0 tokens; without documents or targets the result is empty.
    """
    return Mix(documents, targets, vocabulary).copies()


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The shares reached by ``mix``."""
    return Mix(documents, targets, vocabulary).shares()


def checks(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Whether ``mix`` kept every cap and met every goal."""
    return Mix(documents, targets, vocabulary).checks()
