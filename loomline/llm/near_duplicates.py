"""Near-duplicate texts by a chosen-path similarity join.

A text is the set of its words with their repetitions numbered, so that the
overlap of two sets is the number of words both texts hold and

    overlap / size of the larger set >= SIMILARITY

is the Braun-Blanquet measure that chosen paths are made for.  In every tree a
node of the path so far selects tokens of a text by their minwise hash value,
about 1/RATE of them per text, rare ones rather than common ones, and the text
follows each selected token.  A path ends where the product of the shares of
its words leaves an expected ``NODE / 2`` texts.  Texts that share a node are
compared exhaustively; a node that is larger than ``NODE`` all the same goes one
step deeper; one that stays large after ``MOST_STEPS`` further steps is a true
cluster and is compared block by block.  ``TREES`` independent trees bring
recall to the target.

Within a node a pair is first held against parity maps: a bit is flipped for
every token that hashes to it, so two maps differ in no more bits than the sets
differ in tokens.  A pair whose maps differ in more bits than the similarity
allows can't be similar: this loses nothing.  The rest is verified word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.words import WordHashes, words
from loomline.operators.forest import components
from loomline.runtime import Spool

SIMILARITY = Fraction(4, 5)
#: Texts of fewer characters are not compared.
LEAST_CHARS = 80
#: Shares of texts are known for words in more than this part of them; others count as this rare.
LISTED = 0.001
#: Words in this part of the texts or less are followed alike, more common ones less, down to LEAST_WEIGHT.
PLAIN, LEAST_WEIGHT = 0.1, 0.1
#: A text follows about 1/RATE tokens at each step.
RATE = 1.0
TREES = 24
#: The most steps of a path before nodes are looked at, and the most steps of large nodes after it.
MOST_LEVEL, MOST_STEPS = 12, 6
#: The most texts of a node that are compared exhaustively, and of a block of a cluster.
NODE, BLOCK = 2_048, 256
#: 64-bit words of a parity map.
MAP_WORDS = 4
#: Groups of identical texts up to this size are written out as all pairs, larger ones as pairs with their first copy.
MOST_COPIES = 64

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts whose paths are followed at once, which bounds the memory of a task.
AT_ONCE = 1_000
MAPS = [f"m{k}" for k in range(MAP_WORDS)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roots(trees: int) -> np.ndarray:
    """The first node of every tree."""
    return scramble((np.arange(trees, dtype=np.uint64) + np.uint64(77)) * MIX)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one stretch after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) - np.repeat((ends - counts - starts).astype(np.int32), counts)


class Bags:
    """The token sets of a batch of texts: ``size``, parity ``maps``, and the first occurrences end to end (``firsts`` from ``start``, ``many`` of each)."""

    def __init__(self, texts: list[str], hashes: WordHashes):
        coded = [hashes.of(words(t)) for t in texts]
        self.size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        owner = np.repeat(np.arange(len(coded)), self.size)
        codes = np.concatenate(coded).view(np.uint64) if coded else np.empty(0, dtype=np.uint64)
        order = np.lexsort((codes, owner))
        codes = codes[order]
        self.first = np.ones(len(codes), dtype=bool)
        self.first[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(codes))
        nth = at - np.maximum.accumulate(np.where(self.first, at, 0)) if len(codes) else at
        self.tokens, self.owner = scramble(codes + nth.astype(np.uint64) * MIX), owner
        self.firsts = self.tokens[self.first]
        self.many = np.bincount(owner[self.first], minlength=len(coded))
        self.start = np.cumsum(self.many) - self.many

    def maps(self) -> np.ndarray:
        """One row of ``MAP_WORDS`` words per text."""
        bits = 64 * MAP_WORDS
        place = (scramble(self.tokens ^ MIX) % np.uint64(bits)).astype(np.int64)
        flips = np.bincount(self.owner * bits + place, minlength=len(self.size) * bits) & 1
        return np.packbits(flips.reshape(-1, bits).astype(np.uint8), axis=1).view(np.int64).reshape(-1, MAP_WORDS)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit sums over the tokens: equal for equal bags of words."""
        out = []
        for salt in scramble(np.array([1, 2], dtype=np.uint64) * MIX):
            sums = np.zeros(len(self.size), dtype=np.uint64)
            np.add.at(sums, self.owner, scramble(self.tokens ^ salt))
            out.append(scramble(sums ^ self.size.astype(np.uint64)).view(np.int64))
        return out[0], out[1]


class Shares:
    """The part of the texts that hold a word, for words in more than ``least`` of them."""

    def __init__(self, counts: list[tuple[int, int]], texts: int, least: float):
        found = sorted((np.array([t], dtype=np.int64).view(np.uint64)[0], n / max(1, texts)) for t, n in counts)
        self.tokens = np.array([t for t, _ in found], dtype=np.uint64)
        self.logs = np.log(np.array([min(1.0, s) for _, s in found]))
        self.texts, self.rare = texts, math.log(least)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The logarithm of each token's share."""
        if not len(self.tokens):
            return np.full(len(tokens), self.rare)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.logs[at], self.rare)


def limits(bags: Bags, logs: np.ndarray, rate: float) -> np.ndarray:
    """Below which hash value each first occurrence is selected: 1/rate of those of a text in expectation."""
    weight = np.clip(logs / math.log(PLAIN), LEAST_WEIGHT, 1.0)
    total = np.bincount(np.repeat(np.arange(len(bags.many)), bags.many), weights=weight, minlength=len(bags.many))
    part = np.minimum(1.0, weight / (rate * np.repeat(np.maximum(total, 1e-9), bags.many)))
    return (part * float(2**64 - 4096)).astype(np.uint64)


def step(bags: Bags, limit: np.ndarray, node: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step from every (node, text): (child, index of what it comes from, place of the token in ``firsts``)."""
    place = ragged(bags.start[text], bags.many[text])
    origin = np.repeat(np.arange(len(text), dtype=np.int32), bags.many[text])
    chosen = np.flatnonzero(scramble(np.repeat(node, bags.many[text]) ^ bags.firsts[place]) <= limit[place])
    origin, place = origin[chosen], place[chosen]
    return scramble((node[origin] ^ bags.firsts[place]) + MIX), origin, place


def first_step(bags: Bags, limit: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``step``, from the root of every tree for all texts at once: (child, text, place of the token)."""
    top = roots(trees)
    tree, place = np.nonzero(scramble(top[:, None] ^ bags.firsts[None, :]) <= limit[None, :])
    return scramble((top[tree] ^ bags.firsts[place]) + MIX), bags.owner[bags.first][place], place


def paths(bags: Bags, shares: Shares, trees: int, rate: float, node_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, text) at the end of every path: distinct, in the order of texts."""
    logs = shares.of(bags.firsts)
    limit = limits(bags, logs, rate)
    enough = math.log(max(1.0, node_rows / 2)) - math.log(max(1, shares.texts))  # log of the share of texts at which a path ends
    text = np.repeat(np.flatnonzero(bags.many > 0), trees)
    node = np.tile(roots(trees), len(text) // trees)
    left = np.zeros(len(text))
    taken = np.empty((len(text), 0), dtype=np.int64)
    done_node, done_text = [], []
    for level in range(MOST_LEVEL + 1):
        over = (left <= enough) | (bags.many[text] <= level) | (level == MOST_LEVEL)
        done_node.append(node[over])
        done_text.append(text[over])
        node, text, left, taken = node[~over], text[~over], left[~over], taken[~over]
        if not len(node):
            break
        if not level:
            node, text, place = first_step(bags, limit, trees)
            left, taken = logs[place], place[:, None]
            continue
        child, origin, place = step(bags, limit, node, text)
        fresh = ~(taken[origin] == place[:, None]).any(axis=1)
        node, origin, place = child[fresh], origin[fresh], place[fresh]
        text, left = text[origin], left[origin] + logs[place]
        taken = np.column_stack((taken[origin], place))
    node, text = np.concatenate(done_node), np.concatenate(done_text)
    order = np.lexsort((node, text))
    node, text = node[order], text[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (text[1:] != text[:-1])
    return node[new], text[new]


def batched(batches: Iterator[pd.DataFrame], many: int = AT_ONCE) -> Iterator[pd.DataFrame]:
    """Rows some at a time."""
    for b in batches:
        for k in range(0, len(b), many):
            yield b.iloc[k : k + many]


def classes(segments: DataFrame, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """(``rep``, ``text`` of one segment per bag of words; ``rep``, ``first``, ``n``, ``segment_id`` of all).

    A bag holds all texts of the same words equally often, in whatever order and
    spelling; ``first`` and ``n`` are the first segment and the size of the
    identical texts in it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batched(batches):
            bags = Bags(b["text"].tolist(), hashes)
            h1, h2 = bags.digests()
            yield pd.DataFrame({"segment_id": b["segment_id"], "t1": b["t1"], "t2": b["t2"], "h1": h1, "h2": h2})[bags.size > 0]

    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    wanted = segments.select("segment_id", "text").filter((F.length("text") >= least_chars) & F.col("segment_id").isNotNull())
    hashed = wanted.select("segment_id", "text", t1.alias("t1"), t2.alias("t2")).mapInPandas(run, "segment_id long, t1 long, t2 long, h1 long, h2 long")
    held = hashed.groupBy("segment_id").agg(F.max(F.struct("t1", "t2", "h1", "h2")).alias("h"))
    members = Spool(held.select("segment_id", "h.*"), "segs").df
    identical = members.groupBy("h1", "h2", "t1", "t2").agg(F.min("segment_id").alias("first"), F.count("*").alias("n"))
    reps = identical.groupBy("h1", "h2").agg(F.min("first").alias("rep"))
    listed = members.join(identical, ["h1", "h2", "t1", "t2"]).join(reps, ["h1", "h2"]).select("rep", "first", "n", "segment_id", "t1")
    membership = Spool(listed, "member").df
    one = membership.filter("rep = segment_id").select("segment_id", F.col("t1").alias("_t1"))
    texts = wanted.join(one, "segment_id").filter(t1 == F.col("_t1")).select(F.col("segment_id").alias("rep"), "text").dropDuplicates(["rep"])
    return texts, membership.drop("t1")


def word_shares(texts: DataFrame, least: float) -> Shares:
    """The shares of common words: at most (mean distinct words of a text) / least of them reach the driver."""

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"token": np.fromiter(counts.keys(), dtype=np.int64, count=len(counts)), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = WordHashes(), Counter()
        for b in batched(batches, 5_000):
            found, n = np.unique(Bags(b["text"].tolist(), hashes).firsts.view(np.int64), return_counts=True)
            counts.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
            if len(counts) > 1_000_000:
                yield frame(counts)
                counts.clear()
        yield frame(counts)

    many = texts.count()
    rows = texts.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > least * many).collect()
    return Shares([(r["token"], r["n"]) for r in rows], many, least)


#: Rows on the way to their node. ``state``: 0 to be compared there, 1 of a node known to be large, 2 the mark of such a node.
AT_NODE = "place long, node long, rep long, state int, size int, " + ", ".join(f"{m} long" for m in MAPS)
COMPARED = "node long, rep long, other long, size int, " + ", ".join(f"{m} long" for m in MAPS)


def sent(node: np.ndarray, rep: np.ndarray, size: np.ndarray, maps: np.ndarray, node_rows: int) -> pd.DataFrame:
    """Rows for the shuffle: a node of more than ``node_rows`` rows here is large, so its rows are spread and one mark goes to its place."""
    _, at, counts = np.unique(node, return_inverse=True, return_counts=True)
    large = counts[at] > node_rows
    here = node.view(np.int64)
    place = np.where(large, scramble(rep.view(np.uint64) ^ MIX).view(np.int64), here)
    marks = np.unique(here[large])
    out = {"place": np.append(place, marks), "node": np.append(here, marks), "rep": np.append(rep, np.full(len(marks), -1)),
           "state": np.append(large.astype(np.int32), np.full(len(marks), 2, dtype=np.int32)), "size": np.append(size, np.zeros(len(marks), dtype=np.int64)).astype(np.int32)}
    return pd.DataFrame(out | {m: np.append(maps[:, k], np.zeros(len(marks), dtype=np.int64)) for k, m in enumerate(MAPS)})


def allowed(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The most tokens in which sets of these sizes may differ."""
    top, bottom = similarity.numerator, similarity.denominator
    least = -(-np.maximum(a, b) * top // bottom)
    return a + b - 2 * least


def alike(size_a: np.ndarray, maps_a: np.ndarray, size_b: np.ndarray, maps_b: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs whose parity maps allow the similarity: all similar ones and few others."""
    most = allowed(size_a[:, None], size_b[None, :], similarity)
    differ = np.zeros(most.shape, dtype=np.uint16)
    half = MAP_WORDS // 2
    for k in range(half):
        differ += np.bitwise_count(maps_a[:, None, k] ^ maps_b[None, :, k])
    i, j = np.nonzero(differ.astype(np.int32) <= most)
    differ = differ[i, j].astype(np.int32)
    for k in range(half, MAP_WORDS):
        differ += np.bitwise_count(maps_a[i, k] ^ maps_b[j, k])
    keep = differ <= most[i, j]
    return i[keep], j[keep]


def pair_frame(pairs: np.ndarray) -> pd.DataFrame:
    """Distinct (rep, other) in the form of ``COMPARED``."""
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pd.DataFrame({"node": 0, "rep": pairs[:, 0], "other": pd.array(pairs[:, 1], dtype="Int64"), "size": 0} | dict.fromkeys(MAPS, 0))


def compare_nodes(similarity: Fraction, node_rows: int):
    """A mapInPandas function over rows sorted by node and size: the likely pairs of small nodes (``other`` set); rows of large nodes pass through."""

    def small(rows: pd.DataFrame, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
        rep, size = rows["rep"].to_numpy(), rows["size"].to_numpy()
        maps = np.column_stack([rows[m].to_numpy() for m in MAPS]).view(np.uint64)
        out = [np.empty((0, 2), dtype=np.int64)]
        for a, z in zip(begin, end, strict=True):
            for x in range(a, z, BLOCK):  # sizes rise: a block meets itself and what follows, up to the size that can still be similar
                y = min(x + BLOCK, z)
                last = a + np.searchsorted(size[a:z], int(size[y - 1]) * similarity.denominator // similarity.numerator, "right")
                i, j = alike(size[x:y], maps[x:y], size[x:last], maps[x:last], similarity)
                up = i < j
                out.append(np.column_stack((rep[x + i[up]], rep[x + j[up]])))
        return pair_frame(np.concatenate(out))

    def large(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["state"] < 2]
        return rows.assign(other=pd.array([pd.NA] * len(rows), dtype="Int64"))[["node", "rep", "other", "size", *MAPS]]

    def split(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        node = rows["node"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        begin, end = edges[:-1], edges[1:]
        known = (end - begin > node_rows) | (np.maximum.reduceat(rows["state"].to_numpy(), begin) > 0)
        open_nodes = ~known & (end - begin > 1)
        yield small(rows, begin[open_nodes], end[open_nodes])
        if known.any():
            yield large(rows[np.repeat(known, end - begin)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        passing = None
        for b in batches:
            if passing is not None:  # the rest of a large node: no need to hold it
                rest = b["node"] == passing
                yield large(b[rest])
                b = b[~rest]
                passing = None if len(b) else passing
            if not len(b):
                continue
            held.append(b)
            if sum(map(len, held)) < 50_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            tail = rows["node"] == rows["node"].iloc[-1]
            yield from split(rows[~tail])
            if tail.sum() > node_rows:
                yield large(rows[tail])
                passing, held = rows["node"].iloc[-1], []
            else:
                held = [rows[tail]]
        if held:
            yield from split(pd.concat(held, ignore_index=True))

    return run


def likely_pairs(texts: DataFrame, shares: Shares, similarity: Fraction, trees: int, rate: float, node_rows: int, most_steps: int) -> DataFrame:
    """Distinct (``rep``, ``other``) that share a node and whose parity maps allow the similarity."""
    shared = texts.sparkSession.sparkContext.broadcast(shares)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            parts = []
            for part in batched([b]):
                bags = Bags(part["text"].tolist(), hashes)
                node, text = paths(bags, shared.value, trees, rate, node_rows)
                parts.append((node, part["rep"].to_numpy()[text], bags.size[text], bags.maps()[text]))
            if parts:
                yield sent(*(np.concatenate(x) for x in zip(*parts, strict=True)), node_rows)

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            parts = []
            for part in batched([b]):
                bags = Bags(part["text"].tolist(), hashes)
                node = part["node"].to_numpy().view(np.uint64)
                child, origin, _ = step(bags, limits(bags, shared.value.of(bags.firsts), rate), node, np.arange(len(node)))
                parts.append((child, part["rep"].to_numpy()[origin], bags.size[origin], bags.maps()[origin]))
            if parts:
                yield sent(*(np.concatenate(x) for x in zip(*parts, strict=True)), node_rows)

    at = texts.mapInPandas(start, AT_NODE)
    found, level = [], 0
    while True:
        looked = Spool(at.repartition(F.col("place")).drop("place").sortWithinPartitions("node", "size").mapInPandas(compare_nodes(similarity, node_rows), COMPARED), "nodes")
        found.append(looked.df.filter("other is not null").select("rep", "other"))
        large = looked.df.filter("other is null")
        if not large.limit(1).count():
            break
        if level == most_steps:
            found.append(block_pairs(large.select("node", "rep", "size", *MAPS), similarity))
            break
        at, level = large.select("node", "rep").join(texts, "rep").mapInPandas(deeper, AT_NODE), level + 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def block_pairs(rows: DataFrame, similarity: Fraction, block: int = BLOCK) -> DataFrame:
    """The likely pairs of nodes that no step splits: every block of a node meets every other, each meeting in its own task."""
    sized = rows.join(rows.groupBy("node").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), "node")
    placed = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = met.select("node", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep", "size", *MAPS)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rep, block = rows["rep"].to_numpy(), rows["block"].to_numpy()
        size, maps = rows["size"].to_numpy().astype(np.int32), rows[MAPS].to_numpy().view(np.uint64)
        a, b = np.flatnonzero(block == rows["lo"].iloc[0]), np.flatnonzero(block == rows["hi"].iloc[0])
        i, j = alike(size[a], maps[a], size[b], maps[b], similarity)
        return pair_frame(np.column_stack((rep[a[i]], rep[b[j]])))[["rep", "other"]]

    return keyed.groupBy("node", "lo", "hi").applyInPandas(meet, "rep long, other long")


def links(texts: DataFrame, similarity: Fraction = SIMILARITY, trees: int = TREES, rate: float = RATE, node_rows: int = NODE, most_steps: int = MOST_STEPS, listed: float = LISTED) -> DataFrame:
    """The (``rep``, ``other``) of different texts (``rep``, ``text``) whose shared words reach ``similarity``, verified word by word."""
    held = Spool(texts, "texts").df
    likely = likely_pairs(held, word_shares(held, listed), similarity, trees, rate, node_rows, most_steps)
    top, bottom = similarity.numerator, similarity.denominator

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batched(batches):
            p, q = Bags(b["text"].tolist(), hashes), Bags(b["text_other"].tolist(), hashes)
            token, pair = np.concatenate((p.tokens, q.tokens)), np.concatenate((p.owner, q.owner))
            order = np.lexsort((token, pair))
            token, pair = token[order], pair[order]
            shared = np.bincount(pair[1:][(token[1:] == token[:-1]) & (pair[1:] == pair[:-1])], minlength=len(b))
            yield b.loc[shared * bottom >= top * np.maximum(p.size, q.size), ["rep", "other"]]

    both = likely.join(held, "rep").join(held.select(F.col("rep").alias("other"), F.col("text").alias("text_other")), "other")
    return both.select("rep", "other", "text", "text_other").mapInPandas(verify, "rep long, other long")


def pairs(segments: DataFrame, least_chars: int = LEAST_CHARS, most_copies: int = MOST_COPIES, **how) -> DataFrame:
    """``segment_id_a`` < ``segment_id_b``: segments of ``least_chars`` or more whose words overlap by 0.8 of the longer.

    Texts of the same words equally often are joined once, through their first
    segment, and written out as all pairs, as are their links to other texts.
    Only of more than ``most_copies`` identical texts are the pairs those of
    each copy with the first, and the links to other texts those of the first,
    which keeps every link between different texts; ``grouped`` has one form for
    groups of any size.  Null texts or ids, short texts and texts without a word give no row;
    a repeated id counts once (of different texts under one id, one chosen by hash); an empty table gives an empty result.
    """
    texts, members = classes(segments, least_chars)
    near = links(texts, **how)
    shown_as_such = (F.col("n") <= most_copies) | (F.col("first") == F.col("segment_id"))
    shown = members.filter(shown_as_such).select("rep", "segment_id")
    rest = members.filter(~shown_as_such).select(F.col("first").alias("x"), F.col("segment_id").alias("y"))
    twins = shown.select("rep", F.col("segment_id").alias("x")).join(shown.select("rep", F.col("segment_id").alias("y")), "rep").filter("x < y").select("x", "y")
    across = (
        near.join(shown.select("rep", F.col("segment_id").alias("x")), "rep")
        .join(shown.select(F.col("rep").alias("other"), F.col("segment_id").alias("y")), "other").select("x", "y")
    )
    every = across.unionByName(twins).unionByName(rest)
    return every.select(F.least("x", "y").alias("segment_id_a"), F.greatest("x", "y").alias("segment_id_b")).distinct()


def grouped(segments: DataFrame, least_chars: int = LEAST_CHARS, **how) -> DataFrame:
    """One row per compared segment: its class, the segments it is linked to, and its group.

    ``segment_id``; ``class_id``, the first segment of the same words equally
    often; ``copies`` in that class; ``links``, the number of other segments
    similar to it; ``group_id``, the first segment of all that hang together by
    links.  The form is the same for groups of any size; cases as in ``pairs``.
    """
    texts, members = classes(segments, least_chars)
    near = Spool(links(texts, **how), "links").df
    sizes = Spool(members.groupBy("rep").agg(F.count("*").alias("copies")), "sizes").df
    ends = near.select("rep", "other").unionByName(near.select(F.col("other").alias("rep"), F.col("rep").alias("other")))
    outside = ends.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("outside"))
    group = components(near.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), F.col("least").alias("group_id"))
    known = sizes.join(outside, "rep", "left").join(group, "rep", "left")
    return members.select("rep", "segment_id").join(known, "rep").select(
        "segment_id", F.col("rep").alias("class_id"), "copies", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("group_id", "rep").alias("group_id")
    )


def brute_force(texts: dict[int, str], least_chars: int = LEAST_CHARS, similarity: Fraction = SIMILARITY) -> set[tuple[int, int]]:
    """All pairs by comparing each with each, for tests."""
    bags = {k: Counter(words(t)) for k, t in texts.items() if t and len(t) >= least_chars and words(t)}
    out, ids = set(), sorted(bags)
    sizes = defaultdict(int, {k: sum(b.values()) for k, b in bags.items()})
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (bags[a] & bags[b]).total() * similarity.denominator >= similarity.numerator * max(sizes[a], sizes[b]):
                out.add((a, b))
    return out
