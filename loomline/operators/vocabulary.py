"""Closed vocabularies: raw words to canonical values by a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import token_name

# The words accepted for each canonical value.
WORDS = {
    "severity": {
        "critical": "critical blocker blocking fatal",
        "high": "high major urgent severe",
        "medium": "medium moderate normal warning",
        "low": "low minor info informational",
    },
    "level": {"hard": "hard high critical", "soft": "soft medium low"},
    "open_item": {
        "task": "task todo", "bug": "bug", "risk": "risk", "question": "question", "conflict": "conflict",
        "verification_gap": "verification verification_gap verificationgap",
    },
    "scope": {"active": "active in_progress inprogress ongoing", "blocked": "blocked", "completed": "completed", "partially_completed": "partially_completed", "unknown": "unknown"},
    "claim": {
        "active": "active current open done in_progress inprogress ongoing",
        "superseded": "superseded historical inactive resolved closed",
        "uncertain": "uncertain pending unresolved report reported self_report self_reported failed fail blocked error errors exception",
    },
    "verification": {
        "passed": "passed pass", "failed": "failed fail", "not_run": "not_run notrun nr no_run",
        "unknown": "unknown unsure partial partially reported report self_report self_reported",
    },
}
#: What a missing word means, where that is allowed.
MISSING = {"severity": "high"}


def pairs() -> list[tuple[str, str, str]]:
    """(domain, token, canonical) of all words."""
    return [(d, t, c) for d, values in WORDS.items() for c, tokens in values.items() for t in tokens.split()]


def normalised(rows: DataFrame, domain: str, word: str) -> DataFrame:
    """Adds ``canonical`` for the words of one domain column and one word column; unknown words give null.

    The dimension table is a fixed list and is broadcast.  Extra columns of
    ``rows`` stay as they are.
    """
    table = rows.sparkSession.createDataFrame(pairs(), "_domain string, _token string, canonical string")
    token = token_name(F.col(word))
    joined = rows.join(F.broadcast(table), (F.col(domain) == F.col("_domain")) & (token == F.col("_token")), "left").drop("_domain", "_token")
    for d, value in MISSING.items():
        absent = (F.col(domain) == d) & (F.coalesce(F.col(word), F.lit("")) == "")
        joined = joined.withColumn("canonical", F.when(absent, value).otherwise(F.col("canonical")))
    return joined
