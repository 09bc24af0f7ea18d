"""Reading level of each English document by a familiar-word formula.

grade = a + b * (share of unfamiliar words) + c * (words per sentence)

The familiar words are a high-frequency list: those in at least ``LEAST_SHARE``
of the documents with the shortest sentences, the first ``PLAIN_PART`` of the
English corpus.  (Over the whole corpus a list by frequency fails where, as in
technical text, the words of demanding documents are frequent and those of easy
ones rare.)  The coefficients are fitted to the mean grades that people gave, by
least squares over all graded documents; only sums of products reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.runtime import Spool

#: The part of the documents, those of shortest sentences, whose words are counted, and the share of them that a
#: familiar word stands in at least.  It bounds the list: a mean of d distinct words allows at most d / LEAST_SHARE.
PLAIN_PART, LEAST_SHARE = 1 / 3, 0.05
#: From this estimate upwards a document belongs to level 4 or 5.
DEMANDING = 3.5

WORD = re.compile(r"[^\W\d_]+")
CODE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$")
LOG = re.compile(r"(?m)^[ \t]*(?:\d{4}-\d\d-\d\dT\S+ .*|[-dl][rwx-]{9} .*|(?:not )?ok \d+ .*|error: .*|\S+\.\w+:\d+: .*)$")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n|\n(?=\s*[-*#>\d])")
# Frequent function words that tell English from German where no language is given.
ENGLISH = frozenset("the of and a an in to it is was that by on with not for".split())
GERMAN = frozenset("der die das und ist nicht ein eine zu mit den dem von im auf wurde".split())


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the prose: code blocks and log lines left out."""
    plain = LOG.sub("", CODE.sub("", text.replace("\r\n", "\n").replace("\r", "\n").lower()))
    found = (WORD.findall(s) for s in SENTENCE.split(plain))
    return [s for s in found if s]


def is_english(lang: str | None, found: list[list[str]]) -> bool:
    """By the given language, whatever its spelling; without one by function words."""
    if isinstance(lang, str) and lang.strip():
        return lang.strip().lower().split("-")[0].split("_")[0] in ("en", "eng", "english")
    english = sum(w in ENGLISH for s in found for w in s)
    return english > 0 and english > sum(w in GERMAN for s in found for w in s)


def word_counts(documents: DataFrame) -> DataFrame:
    """``word`` (null: the documents themselves), ``length``, ``docs``: English documents by words per sentence and word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                found = sentences(text)
                if not found or not is_english(lang, found):
                    continue
                length = sum(map(len, found)) // len(found)
                counts[None, length] += 1
                counts.update((w, length) for w in {w for s in found for w in s})
            if len(counts) > 500_000:
                yield frame(counts)
                counts.clear()
        yield frame(counts)

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [k[0] for k in counts], "length": np.array([k[1] for k in counts], dtype="int64"), "docs": np.array(list(counts.values()), dtype="int64")})

    part = documents.select("text", "lang").filter("text is not null and text <> ''").mapInPandas(run, "word string, length long, docs long")
    return part.groupBy("word", "length").agg(F.sum("docs").alias("docs"))


def familiar_words(documents: DataFrame, least_share: float = LEAST_SHARE, plain_part: float = PLAIN_PART) -> DataFrame:
    """The familiar words (``word``), from document frequencies over all English documents of short sentences."""
    counts = Spool(word_counts(documents), "words").df
    by_length = counts.filter("word is null").select("length", "docs")  # one row per whole number of words
    running = by_length.withColumn("upto", F.sum("docs").over(Window.orderBy("length"))).withColumn("all", F.sum("docs").over(Window.partitionBy()))
    cut = running.filter(F.col("upto") >= F.col("all") * plain_part).agg(F.min_by(F.struct("length", "upto"), "length").alias("c")).first()["c"]
    if cut is None:
        return counts.select("word").filter("false")
    plain = counts.filter(F.col("word").isNotNull() & (F.col("length") <= cut["length"])).groupBy("word").agg(F.sum("docs").alias("docs"))
    return plain.filter(F.col("docs") >= least_share * cut["upto"]).select("word")


def features(documents: DataFrame, familiar: DataFrame) -> DataFrame:
    """``doc_id``, ``unfamiliar``, ``sentence_words`` of every English document with a word in its prose."""
    known = documents.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in familiar.collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = known.value
        for b in batches:
            rows = []
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                found = sentences(text)
                if found and is_english(lang, found):
                    n = sum(map(len, found))
                    rows.append((doc, sum(w not in words for s in found for w in s) / n, n / len(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "unfamiliar", "sentence_words"])

    wanted = documents.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and text <> ''")
    return wanted.mapInPandas(run, "doc_id long, unfamiliar double, sentence_words double")


def fit(found: DataFrame, grades: DataFrame) -> list[float]:
    """Intercept and the two coefficients, by least squares on the mean grade of each graded document."""
    marks = grades.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("grade").alias("y"))
    x = [F.lit(1.0), F.col("unfamiliar"), F.col("sentence_words")]
    sums = found.join(marks, "doc_id").agg(
        *(F.sum(x[i] * x[j]).alias(f"a{i}{j}") for i in range(3) for j in range(3)), *(F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(3))
    ).first()
    if sums["b0"] is None:
        raise ValueError("no graded document")
    a = np.array([[sums[f"a{i}{j}"] for j in range(3)] for i in range(3)])
    return np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(3)]), rcond=None)[0].tolist()


def levels(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """``doc_id``, ``unfamiliar``, ``sentence_words``, ``grade`` of each English document.

    Documents of another language and texts without prose (null, empty, only
    code or logs) have no row.  Where no language is given, function words tell.
    Texts of any length are read whole.  A ``doc_id`` on several rows gives as
    many rows.  Grades that are null are ignored; without any graded document
    there is nothing to fit and an error is raised; without documents the
    result is empty.
    """
    found = Spool(features(documents, familiar_words(documents)), "reading").df
    if not found.limit(1).count():
        return found.withColumn("grade", F.lit(None).cast("double"))
    a, b, c = fit(found, grades)
    estimate = F.lit(a) + F.lit(b) * F.col("unfamiliar") + F.lit(c) * F.col("sentence_words")
    return found.withColumn("grade", F.least(F.lit(5.0), F.greatest(F.lit(1.0), estimate)))


def demanding(documents: DataFrame, grades: DataFrame, least: float = DEMANDING) -> DataFrame:
    """The ``doc_id`` of English documents of level 4 or 5."""
    return levels(documents, grades).filter(F.col("grade") >= least).select("doc_id").distinct()


def profile(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """Documents by source (its spelling made uniform) and rounded level."""
    kind = F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_").alias("source")
    names = documents.select("doc_id", kind).distinct()
    level = levels(documents, grades).select("doc_id", F.round("grade").cast("int").alias("level")).distinct()
    return level.join(names, "doc_id").groupBy("source", "level").agg(F.count("*").alias("docs"))


def agreement(documents: DataFrame, grades: DataFrame, least: float = DEMANDING) -> DataFrame:
    """How well the formula agrees with grades it was not fitted to: ``fold``, ``docs``, ``agreeing``, ``demanding``, ``found``.

    Graded documents are halved by the hash of ``doc_id``; each half is judged by
    coefficients fitted to the other.  ``demanding`` are those graded ``least``
    or more on average, ``found`` those of them that the estimate finds.
    """
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    held = Spool(features(documents, familiar_words(documents)), "reading").df
    marks = grades.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("grade").alias("y"))
    out = []
    for fold in (0, 1):
        a, b, c = fit(held.filter(half != fold), grades)
        judged = held.filter(half == fold).join(marks, "doc_id").select((F.lit(a) + F.lit(b) * F.col("unfamiliar") + F.lit(c) * F.col("sentence_words") >= least).alias("told"), (F.col("y") >= least).alias("is"))
        out.append(judged.agg(
            F.lit(fold).alias("fold"), F.count("*").alias("docs"), F.count_if(F.col("told") == F.col("is")).alias("agreeing"),
            F.count_if("is").alias("demanding"), F.count_if(F.col("is") & F.col("told")).alias("found"),
        ))
    return out[0].unionByName(out[1])
