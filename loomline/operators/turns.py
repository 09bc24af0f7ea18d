"""Turns of a session and the results worth keeping of each.

One streaming pass per source: rows arrive in file order, only the state of the
turn at hand is held, so a source of any length needs little memory.  All texts
are judged beforehand by column expressions; Python sees flags and scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import messages as M
from loomline.functions.text import compact_lower

#: The most assistant milestones and the most tool results kept of an unfinished turn.
MOST = 6
RECORDS = "source_id string, turn_index long, mode string, assistant_ids array<string>, tool_ids array<string>, user_ids array<string>, raw_messages long"


def judged(entries: DataFrame) -> DataFrame:
    """The user, assistant and tool messages of all sources with the flags that selection needs; cut-off assistant messages left out."""
    m = M.with_message(M.distinct_entries(entries)).filter(F.col("role").isin("user", "assistant", "toolResult") & ~M.is_degenerate())
    m = m.withColumn("c", compact_lower(F.col("text")))
    c, err = F.col("c"), F.col("is_error")
    by_user, by_tool = F.col("role") == "user", F.col("role") == "toolResult"
    return m.select(
        "source_id", F.col("line_index").cast("long").alias("line"), "entry_id", "role", (c != "").alias("has_text"), M.has_tool_call().alias("calls"), F.xxhash64(c).alias("said"),
        F.when(by_user, M.low_value(c)).alias("low"), F.when(by_user, M.continuation(c)).alias("goes_on"),
        F.when(F.col("role") == "assistant", M.milestone_score(c)).alias("milestone"), F.when(by_tool, M.evidence_signal(c, err) + M.tool_weight(F.col("tool_name"), err)).alias("evidence"),
        "is_error", "tool_name", *(F.when(by_tool, M.matches(c, p)).alias(n) for n, p in (("verifies", M.VERIFIES), ("mutates", M.MUTATES), ("reports", M.REPORTS))),
    )


@dataclass
class Turn:
    """What is known of the turn at hand: in proportion to its users and tools, not to its messages."""

    number: int
    said: set = field(default_factory=set)
    users: list = field(default_factory=list)
    seen: int = 0
    active: bool = False
    terminal: str | None = None
    latest: tuple | None = None
    milestones: list = field(default_factory=list)
    newest: dict = field(default_factory=dict)
    by_tool: dict = field(default_factory=dict)

    def user(self, r) -> None:
        self.seen += 1
        if r.has_text:
            self.said.add(r.said)
        if not r.low:
            self.users.append(r.entry_id)

    def assistant(self, r) -> None:
        self.seen += 1
        self.active = True
        if not r.has_text:
            return
        process = r.milestone <= -1000
        self.terminal = None if r.calls or process else r.entry_id
        if not process:
            self.latest = (self.seen, r.entry_id)
            if r.milestone >= 55:
                self.milestones = [*self.milestones, self.latest][-MOST:]

    def tool(self, r) -> None:
        self.seen += 1
        self.active = True
        self.terminal = None
        if not r.has_text:
            return
        at = (self.seen, r.entry_id)
        if r.is_error or r.evidence >= 100:
            self.newest["error"] = at
        if r.evidence >= 35:
            for name, fits in (("verify", r.verifies), ("mutate", r.mutates), ("report", r.reports)):
                if fits:
                    self.newest[name] = at
            key = r.tool_name or at
            self.by_tool[key] = at
            if not r.tool_name and len(self.by_tool) > 4 * MOST:
                nameless = sorted((v for k, v in self.by_tool.items() if k == v), reverse=True)[MOST:]
                for v in nameless:
                    del self.by_tool[v]

    def record(self, source) -> tuple:
        assistants, tools, mode = [], [], None
        if self.terminal:
            mode, assistants = "assistant_final", [self.terminal]
        else:
            if self.latest:
                assistants = [e for _, e in sorted({*self.milestones, self.latest})[-MOST:]]
            chosen = set(self.newest.values())
            for at in sorted(self.by_tool.values(), reverse=True):
                if len(chosen) >= MOST:
                    break
                chosen.add(at)
            tools = [e for _, e in sorted(chosen)[-MOST:]]
            mode = "evidence_fallback" if assistants or tools else "user_only" if self.users else None
        return source, self.number, mode, assistants, tools, self.users, self.seen


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by source and line: one row per turn; ``mode`` is null where nothing is worth keeping."""
    columns = [c.split()[0] for c in RECORDS.split(", ")]
    source, turn, started, none = None, None, False, object()
    number = 0
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            at = none if r.source_id is None else r.source_id
            if not started or at != source:
                if turn:
                    out.append(turn.record(None if source is none else source))
                source, turn, number, started = at, None, 0, True
            if r.role == "user" and turn and turn.active:
                repeated = r.has_text and r.said in turn.said
                if turn.terminal or not (repeated or r.goes_on):
                    out.append(turn.record(None if source is none else source))
                    turn = None
                elif repeated:
                    continue
            if turn is None:
                number += 1
                turn = Turn(number)
            {"user": turn.user, "assistant": turn.assistant, "toolResult": turn.tool}[r.role](r)
        yield pd.DataFrame(out, columns=columns)
    if turn:
        yield pd.DataFrame([turn.record(None if source is none else source)], columns=columns)


def all_turns(entries: DataFrame) -> DataFrame:
    """Every turn of every source, with null ``mode`` where no record is kept."""
    flags = judged(entries)
    return flags.repartition(F.col("source_id")).sortWithinPartitions("source_id", "line", "entry_id").mapInPandas(fold, RECORDS)


def turn_records(entries: DataFrame) -> DataFrame:
    """The kept record of each turn: final answer, else fallbacks of assistant and tools, else the user's request alone.

    A user message opens a turn if there is none, or if the turn at hand has
    activity and either a final answer or a request that is neither repeated nor
    continued; a repeated request of an unfinished turn is dropped.  Roles are
    taken as written; entries of other roles, cut-off assistant messages, lines
    delivered twice and unreadable messages count for nothing; null sources form
    one; an empty table has no turns.
    """
    return all_turns(entries).filter("mode is not null")


def selection_stats(entries: DataFrame) -> DataFrame:
    """Per source: messages, turns, and what selection kept and dropped."""
    raw = M.with_message(M.distinct_entries(entries)).filter("role is not null").groupBy("source_id").agg(
        F.count("*").alias("raw_messages"), F.sum(M.is_degenerate().cast("long")).alias("degenerate")
    )
    n = lambda c: F.size(c).cast("long")
    kept = all_turns(entries).groupBy(F.col("source_id").alias("_s")).agg(
        F.count("*").alias("turns"),
        F.sum(F.when(F.col("mode").isNotNull(), n("assistant_ids") + n("tool_ids") + n("user_ids")).otherwise(0)).alias("selected"),
        F.count_if(F.col("mode") == "assistant_final").alias("finals"), F.count_if(F.col("mode") == "evidence_fallback").alias("fallbacks"),
        F.sum(F.when(F.col("mode").isNotNull(), n("user_ids")).otherwise(0)).alias("users"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "selected", "finals", "fallbacks", "users")]
    both = raw.join(kept, F.col("source_id").eqNullSafe(F.col("_s")), "left").select("source_id", "raw_messages", "degenerate", *zero)
    return both.withColumn("dropped", F.greatest(F.lit(0), F.col("raw_messages") - F.col("selected") - F.col("degenerate")) + F.col("degenerate"))
