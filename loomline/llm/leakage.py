"""Evaluation texts leaking into training text.

The test items are indexed once: an inverted list per word with the BM25 weight
of each item that holds it, and beside it the largest weight in each block of
items.  Each document is cut into overlapping passages such that any run of
``run_words`` words lies whole in one of them, and every passage is a query.  A
passage holding a run of an item scores at least the smallest BM25 sum of any run
of that item, so that sum is the item's exact threshold: retrieval loses
nothing.  As in block-max WAND only the lists of words are walked without which no item
can reach the least threshold; blocks whose maxima stay below their least
threshold are left out, and only items of the others are scored.  Thousands of
passages go through these steps at once.  Retrieved pairs are verified word by
word, in question and answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.words import words
from loomline.runtime import Spool

RUN_WORDS = 15
#: Items per block of the index.
BLOCK = 2
#: Words of test items in one index (about 12 bytes each in a task); each further index reads the documents once more.
INDEX_WORDS = 10_000_000
K1, B = 1.2, 0.75
#: Words from one passage to the next: a passage holds that many runs, and the fewer the closer are its bounds.
STRIDE = 8
#: Passages looked at together, and list entries gathered at once, which bound the memory of a task.
AT_ONCE, ENTRIES = 4_000, 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Up to this many blocks the lists of all words of a passage are walked.
SHORT = 1_000
#: Markup between words: tags and entities.
MARKUP = re.compile(r"<[^<>\n]{1,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")
#: What stands between the question and the answer of an item.
ANSWER = "\nAnswer:"
OVERLAPS = "doc_id long, item_id long, question_words long, answer_words long, whole boolean"


def stretches(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - start, many)


def found_at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key asked for, 0 where there is none (``keys`` sorted)."""
    if not len(keys):
        return np.zeros(len(asked), dtype=np.float32)
    asked = asked.astype(keys.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.float32(0))


def narrow(keys: np.ndarray, most: int) -> np.ndarray:
    """Keys in half the space where all of them, up to ``most``, fit."""
    return keys.astype(np.int32) if most < 2**31 else keys


class Index:
    """Inverted lists of the test items with block maxima, and exact run thresholds."""

    def __init__(self, items: list[tuple[int, str]], run_words: int = RUN_WORDS, block: int = BLOCK):
        self.run_words, self.block = run_words, block
        kept = [(i, w, len(words(t.split(ANSWER, 1)[0])), ANSWER in t) for i, t in items if t and len(w := words(t)) >= run_words]
        # Items that share words stand in one block, so that block maxima stay low: order by their rarest words.
        df = Counter(x for _, w, *_ in kept for x in set(w))
        kept.sort(key=lambda k: (sorted(set(k[1]), key=lambda x: (df[x], x))[:3], k[0]))
        self.ids = np.array([k[0] for k in kept], dtype=np.int64)
        self.questions = np.array([k[2] for k in kept], dtype=np.int64)
        self.answered = np.array([k[3] for k in kept], dtype=bool)
        self.vocabulary = {x: k for k, x in enumerate(sorted(df))}
        self.codes = [np.array([self.vocabulary[x] for x in w], dtype=np.int32) for _, w, *_ in kept]
        n, mean = max(1, len(kept)), sum(map(len, self.codes)) / max(1, len(kept))
        self.blocks = -(-len(kept) // block)
        holders = np.array([df[x] for x in sorted(df)], dtype=np.float64)
        idf = np.log(1 + (n - holders + 0.5) / (holders + 0.5))

        word, item, weight, lows = [], [], [], []
        for j, c in enumerate(self.codes):
            distinct, tf = np.unique(c, return_counts=True)
            w = (idf[distinct] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))).astype(np.float32)
            word.append(distinct)
            item.append(np.full(len(distinct), j))
            weight.append(w)
            runs = np.sort(np.lib.stride_tricks.sliding_window_view(np.searchsorted(distinct, c), run_words), axis=1)
            sums = np.where(np.diff(runs, axis=1, prepend=-1) != 0, w[runs].astype(np.float64), 0.0).sum(axis=1)
            lows.append(sums.min() * (1 - 1e-4))
        word, item, weight = (np.concatenate(x) if x else np.empty(0, dtype=d) for x, d in ((word, np.int64), (item, np.int64), (weight, np.float32)))
        self.lows = np.full(self.blocks * block, np.inf, dtype=np.float32)
        self.lows[: len(kept)] = lows
        self.block_lows = self.lows.reshape(-1, block).min(axis=1) if self.blocks else np.empty(0, dtype=np.float32)
        self.least = float(self.block_lows.min()) if self.blocks else np.inf

        runs = [(j, np.arange(len(c) - run_words + 1), self.run_hashes(np.lib.stride_tricks.sliding_window_view(c, run_words))) for j, c in enumerate(self.codes)]
        key = np.concatenate([h + np.array([j], dtype=np.uint64) * MIX for j, _, h in runs]) if runs else np.empty(0, dtype=np.uint64)
        begin = np.concatenate([b for _, b, _ in runs]) if runs else np.empty(0, dtype=np.int64)
        rise = np.argsort(key, kind="stable")
        self.run_keys, self.run_begins = key[rise], begin[rise]

        order = np.lexsort((item, word))
        word, item, weight = word[order].astype(np.int64), item[order], weight[order]
        most = (len(df) + 2) * max(1, self.blocks * block)
        self.keys, self.weights = narrow(word * (self.blocks * block) + item, most), weight  # the inverted lists, end to end
        at = word * self.blocks + item // block
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, dtype=np.int64)
        self.block_keys, self.block_max = narrow(at[first], most), np.maximum.reduceat(weight, first) if len(at) else weight
        bounds = np.searchsorted(self.block_keys, np.arange(len(df) + 2) * max(1, self.blocks))
        self.list_start, self.list_many = bounds[:-1], np.diff(bounds)
        self.most = np.zeros(len(df) + 1, dtype=np.float32)
        np.maximum.at(self.most, word, weight)

    @staticmethod
    def run_hashes(runs: np.ndarray) -> np.ndarray:
        """A hash of each row of word codes along the last axis."""
        total = np.zeros(runs.shape[:-1], dtype=np.uint64)
        for k in range(runs.shape[-1]):
            total = (total ^ runs[..., k].astype(np.uint64)) * MIX
            total ^= total >> np.uint64(32)
        return total

    def verify(self, passages: np.ndarray, p: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(passage, item position, begin in the item) of every run that a retrieved pair shares, word by word."""
        if not len(p):
            return
        mine = np.lib.stride_tricks.sliding_window_view(passages, self.run_words, axis=1)[p]
        asked = self.run_hashes(mine) + j[:, None].astype(np.uint64) * MIX
        first, last = np.searchsorted(self.run_keys, asked, "left"), np.searchsorted(self.run_keys, asked, "right")
        for row, k in zip(*np.nonzero(last > first), strict=True):
            for at in range(first[row, k], last[row, k]):
                begin = self.run_begins[at]
                if np.array_equal(mine[row, k], self.codes[j[row]][begin : begin + self.run_words]):
                    yield int(p[row]), int(j[row]), int(begin)

    def retrieve(self, passages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, item positions), some at a time, of all passages whose score reaches the item's threshold.

        passages: one row of word codes each, padded with the code of no word.
        """
        none = len(self.vocabulary)
        distinct = np.sort(passages, axis=1)
        distinct[:, 1:][distinct[:, 1:] == distinct[:, :-1]] = none
        upper = self.most[distinct]
        distinct, upper = distinct[(alive := upper.sum(axis=1) >= self.least)], upper[alive]
        alive = np.flatnonzero(alive)
        rise = np.argsort(upper, axis=1)
        distinct, sums = np.take_along_axis(distinct, rise, axis=1).astype(np.int64), np.cumsum(np.take_along_axis(upper, rise, axis=1), axis=1)
        # Without all needed words an item stays below every threshold.  Where lists are short, walking all costs less than looking up the rest.
        needed = (sums >= self.least) | (self.blocks <= SHORT)
        rest = np.where(needed, 0, sums).max(axis=1)
        sizes = np.where(needed, self.list_many[distinct], 0).sum(axis=1)
        part = np.cumsum(sizes) // ENTRIES
        for chunk in np.unique(part):
            mine = np.flatnonzero(part == chunk)
            yield self.score(alive[mine], distinct[mine], needed[mine], rest[mine])

    def score(self, ids: np.ndarray, distinct: np.ndarray, needed: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps of ``retrieve`` for some passages: lists, block bounds, items."""
        row, column = np.nonzero(needed)
        code = distinct[row, column]
        place = stretches(self.list_start[code], self.list_many[code])
        key = np.repeat(row * self.blocks - code * self.blocks, self.list_many[code]) + self.block_keys[place]
        if len(distinct) * self.blocks <= ENTRIES:  # few enough blocks to add up in place
            bound = np.bincount(key, weights=self.block_max[place], minlength=len(distinct) * self.blocks)
            met = np.flatnonzero(bound)
            bound = bound[met]
        else:
            met, at = np.unique(key, return_inverse=True)
            bound = np.bincount(at, weights=self.block_max[place], minlength=len(met))
        row, block = np.divmod(met, max(1, self.blocks))
        keep = bound + rest[row] >= self.block_lows[block]
        row, block, bound = row[keep], block[keep], bound[keep]
        at, column = np.nonzero(~needed[row])
        more = found_at(self.block_keys, self.block_max, distinct[row[at], column] * self.blocks + block[at])
        keep = bound + np.bincount(at, weights=more, minlength=len(row)) >= self.block_lows[block] * (1 - 1e-5)
        row, block = row[keep], block[keep]
        item = (block[:, None] * self.block + np.arange(self.block)).ravel()
        row = np.repeat(row, self.block)
        total = np.zeros(len(row), dtype=np.float64)
        for k in range(distinct.shape[1]):
            total += found_at(self.keys, self.weights, distinct[row, k] * (self.blocks * self.block) + item)
        hit = total >= self.lows[item] * (1 - 1e-5)
        return ids[row[hit]], item[hit]

    def leaks(self, texts: list[str]) -> dict[tuple[int, int], set[int]]:
        """(position of the text, position of an item): where the runs begin in the item that the text holds."""
        found = self.leaks_in(list(enumerate(texts)))
        marked = [(k, MARKUP.sub(" ", t)) for k, t in enumerate(texts) if "<" in t or "&" in t]
        for key, begins in self.leaks_in([(k, t) for k, t in marked if t != texts[k]]).items():
            found.setdefault(key, set()).update(begins)
        return found

    def leaks_in(self, texts: list[tuple[int, str]]) -> dict[tuple[int, int], set[int]]:
        """As ``leaks``, for numbered texts, with markup taken as words."""
        n, found, none = self.run_words, {}, len(self.vocabulary)
        if not len(self.ids):
            return found
        held: list[np.ndarray] = []
        origin: list[int] = []

        def flush() -> None:
            if not held:
                return
            passages = np.concatenate(held)
            for some in self.retrieve(passages):
                for p, j, begin in self.verify(passages, *some):
                    found.setdefault((origin[p], j), set()).add(begin)
            held.clear()
            origin.clear()

        span = np.arange(n - 1 + STRIDE)
        for k, text in texts:
            all_words = words(text)
            if len(all_words) < n:
                continue
            coded = np.full(len(all_words) + 2 * n, none, dtype=np.int32)
            coded[: len(all_words)] = list(map(self.vocabulary.get, all_words, repeat(none)))
            # A run holds only words of the index: look at the stretches of them.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (coded != none).view(np.int8), [0]))))
            for begin, end in zip(edges[::2], edges[1::2], strict=True):
                if end - begin < n:
                    continue
                at = np.arange(begin, end - n + 1, STRIDE)
                held.append(np.where(at[:, None] + span < end, coded[at[:, None] + span], none))
                origin += [k] * len(at)
                if len(origin) >= AT_ONCE:
                    flush()
        flush()
        return found

    def overlap(self, item: int, begins: set[int]) -> tuple[int, int, bool]:
        """Words of the question and of the answer that the runs cover, and whether they cover the whole item."""
        covered = np.zeros(len(self.codes[item]), dtype=bool)
        for b in begins:
            covered[b : b + self.run_words] = True
        asked = self.questions[item]
        answer = covered[asked + 1 :] if self.answered[item] else covered[:0]
        return int(covered[:asked].sum()), int(answer.sum()), bool(covered.all())


def overlaps(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS, index_words: int = INDEX_WORDS) -> DataFrame:
    """``OVERLAPS``: each document and item that share a run of ``run_words`` words, and how much of the item such runs cover.

    The question is the text before ``ANSWER``, the answer what follows.  Null
    and short texts give no row; items of fewer words cannot leak; texts of any
    length are read whole; repeated rows give one row; other columns are
    ignored.  Items of more than ``index_words`` words in all are searched in
    several indexes, one after the other, each reading the documents once.
    """
    spark = documents.sparkSession
    wanted = documents.select("doc_id", "text").filter("doc_id is not null and text is not null and text <> ''")
    tests = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = tests.agg(F.sum(F.length("text") / 5)).first()[0] or 0  # about the number of words
    shards = max(1, -(-int(size) // index_words))

    def search(shard: int) -> DataFrame:
        mine = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).collect()  # about index_words words
        shared = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in mine], run_words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                ids = b["doc_id"].to_numpy()
                rows = [(ids[k], index.ids[j], *index.overlap(j, begins)) for (k, j), begins in index.leaks(b["text"].tolist()).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "question_words", "answer_words", "whole"])

        return wanted.mapInPandas(run, OVERLAPS)

    if shards == 1:
        found = search(0)
    else:
        parts = [Spool(search(k), "leaks").df for k in range(shards)]
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
    return found.groupBy("doc_id", "item_id").agg(F.max("question_words").alias("question_words"), F.max("answer_words").alias("answer_words"), F.max("whole").alias("whole"))


def leaked(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Distinct (``doc_id``, ``item_id``) of ``overlaps``."""
    return overlaps(documents, items, run_words).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per test item: how many documents leak it (0 where none does, null where it is too short to be found)."""
    hits = leaked(documents, items).groupBy("item_id").agg(F.count("*").alias("leaking_docs"))
    long_enough = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+")) >= RUN_WORDS
    listed = items.select("item_id", "task", long_enough.alias("findable")).distinct()
    return listed.join(hits, "item_id", "left").select("item_id", "task", F.when(F.col("findable"), F.coalesce("leaking_docs", F.lit(0))).cast("long").alias("leaking_docs"))
