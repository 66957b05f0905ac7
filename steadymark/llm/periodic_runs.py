"""Periodic runs of words by suffix trees.

A run is a stretch with a smallest period that no neighbouring word extends. Every run that holds two of its periods has
a Lyndon root: at some place the longest Lyndon word, in the order of words or in the reverse order, is one period. The
longest Lyndon word at a place ends before the next smaller suffix. Extending each of these words to both sides as far
as the period holds gives all runs. The lengths of the extensions are depths of least common ancestors in a suffix
tree of the words and in one of the reversed words; the trees are built by Ukkonen's algorithm, and an ancestor is the
least depth between two leaves in a tour of the tree.

Runs of many periods are wanted only, and most texts have none. A run of four periods q has more than 3 q - 2 pairs of words
in a row that come again within q words. Only stretches with that many such pairs get trees: the rest has no such run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import batches_of, mixed
from steadymark.llm.word_streams import words_of

#: A run has this many periods and this many words at least.
PERIODS, LEAST = 4, 6
#: Depths of a group whose least is kept ready.
GROUP = 16

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
_DDL = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"


class SuffixTree:
    """The suffix tree of a list of numbers above 0 by Ukkonen's algorithm; 0 is added as the end.

    Node 0 is the root; the edge to a node is ``text[start[node] : end[node]]``. ``kids`` are dictionaries by first number,
    None for a leaf.
    """

    def __init__(self, values: list[int]):
        self.text = text = [*values, 0]
        size = len(text)
        self.start, self.end, self.kids = start, end, kids = [0], [0], [{}]
        link = [0]
        node = edge = length = waiting = 0
        for place, number in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = place
                first = text[edge]
                below = kids[node].get(first)
                if below is None:
                    kids[node][first] = len(start)
                    start.append(place)
                    end.append(size)
                    kids.append(None)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    span = min(end[below], place + 1) - start[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    middle = start[below] + length
                    if text[middle] == number:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    start += [start[below], place]
                    end += [middle, size]
                    kids += [{text[middle]: below, number: split + 1}, None]
                    link += [0, 0]
                    kids[node][first] = split
                    start[below] = middle
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = place - waiting + 1

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order of their numbers, or with numbers ``falling`` (the end is least in both), and the
        least depth of a node between each suffix and the one before it."""
        start, end, kids = self.start, self.end, self.kids
        size = len(self.text)
        suffixes, depths = [], []
        order = (lambda number: (number > 0, -number)) if falling else None
        least = 0
        above = [(0, 0, 0)]
        while above:
            node, depth, branch = above.pop()
            least = min(least, branch)
            below = kids[node]
            if below is None:
                suffixes.append(size - depth)
                depths.append(least)
                least = size
                continue
            for number in sorted(below, key=order, reverse=True):
                child = below[number]
                above.append((child, depth + end[child] - start[child], depth))
        return np.array(suffixes), np.array(depths)


class Least:
    """The least of any stretch of values in constant time: of whole groups by doubling, of parts by running minima."""

    def __init__(self, values: np.ndarray):
        groups = -(-len(values) // GROUP)
        held = np.full(groups * GROUP, np.iinfo(np.int64).max)
        held[: len(values)] = values
        rows = held.reshape(groups, GROUP)
        self.values = held
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= groups:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of ``values[low : high + 1]`` for each pair of places."""
        left, right = low // GROUP, high // GROUP
        found = np.minimum(self.onward[low], self.upto[high])
        count = right - left - 1
        for level in range(len(self.levels)):
            at = np.flatnonzero((count >= 1 << level) & (count < 2 << level))
            if len(at):
                values = self.levels[level]
                found[at] = np.minimum(found[at], np.minimum(values[left[at] + 1], values[right[at] - (1 << level)]))
        at = np.flatnonzero(left == right)
        if len(at):
            inside = self.values[low[at]]
            for step in range(1, GROUP):
                inside = np.minimum(inside, self.values[np.minimum(low[at] + step, high[at])])
            found[at] = inside
        return found


class Common:
    """Lengths of the common beginnings of two suffixes."""

    def __init__(self, suffixes: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.least = Least(depths)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least.of(np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the end the next one that is smaller."""
    ranks, found, waiting = rank.tolist(), [0] * (len(rank) - 1), []
    for place, own in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > own:
            found[waiting.pop()] = place
        waiting.append(place)
    return np.array(found, np.int64)


def runs_of(values: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> np.ndarray:
    """``(start, length, period)`` of all runs of at least ``periods`` (two or more) periods and ``least`` numbers, in order."""
    n = len(values)
    numbers = (np.unique(values, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(numbers)
    suffixes, depths = tree.tour()
    ahead = Common(suffixes, depths)
    other = tree.tour(falling=True)[0]
    rank = np.empty(n + 1, np.int64)
    rank[other] = np.arange(n + 1)
    del tree
    back = Common(*SuffixTree(numbers[::-1]).tour())
    found = []
    for order in (ahead.rank, rank):
        second = next_smaller(order)
        first = np.arange(n)
        some = (second < n) & (periods * (second - first) <= n)
        first, second = first[some], second[some]
        if not len(first):
            continue
        start = first - back.of(n - first, n - second)
        length = second + ahead.of(first, second) - start
        period = second - first
        enough = length >= np.maximum(least, periods * period)
        found.append(np.stack([start, length, period], axis=1)[enough])
    every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    every = np.unique(every, axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


@dataclass
class Stretches:
    """Word ranges ``low`` to ``high`` that may hold runs, each with a word to either side of any run it holds."""

    low: np.ndarray
    high: np.ndarray


def stretches(hashes: np.ndarray, first: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> Stretches:
    """Where the texts ``first[d] : first[d + 1]`` of a batch of words may hold a run of ``periods`` periods and ``least`` words.

    A run of L words with period q has L - q - 1 pairs of words in a row that come again within q words. So of c pairs
    in a row that come again within some limit, only those within (c + 1) / (periods - 1) can belong to a run.
    """
    n = len(hashes)
    if n < 2:
        return Stretches(np.empty(0, np.int64), np.empty(0, np.int64))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = mixed(hashes[:-1] * np.uint64(3) + mixed(hashes[1:]) + text[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(pairs, kind="stable")
    same = (pairs[order[1:]] == pairs[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    far = n + 1
    distance = np.full(n - 1, far)
    distance[order[:-1][same]] = (order[1:] - order[:-1])[same]
    distance[text[1:] != text[:-1]] = far
    # The fewest such pairs of a run, over all its possible periods: L - q - 1 for L = max(least, periods * q).
    fewest = min(max(least, periods * q) - q - 1 for q in range(1, least + 1))
    kept = distance < far
    while True:
        marks = np.diff(np.concatenate([[0], (kept).view(np.int8), [0]]))
        low, high = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)
        limit = np.where(high - low < fewest, 0, (high - low + 1) // (periods - 1))
        # Stretches do not cross texts by more than the pair at their end: pairs over an edge are far.
        still = kept.copy()
        still[kept] = distance[kept] <= np.repeat(limit, high - low)
        if (still == kept).all():
            break
        kept = still
    if not len(low):
        return Stretches(low, high)
    own = text[low]
    low, high = np.maximum(low - 1, first[own]), np.minimum(high + limit + 2, first[own + 1])
    opens = np.concatenate([[True], (low[1:] >= np.maximum.accumulate(high)[:-1]) | (own[1:] != own[:-1])])
    return Stretches(low[opens], np.maximum.reduceat(high, np.flatnonzero(opens)))


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words joined by a space, without those that a run holds after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
    return b" ".join(words).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``runs`` (start, length and period in words, by start and period) and ``text`` of every row of ``docs``.

    A run is a stretch of words with a smallest period that no neighbouring word extends, of at least ``periods`` (three or more)
    periods and ``least`` words. ``text`` are the words, joined by a space, without those that a run holds after its
    first period. Words are parted by ASCII white space and compared as they are. A null or empty text, or one
    without words, has no runs and an empty text. Each row is taken alone, so rows and ids may repeat and ids be null;
    an empty table gives no rows. Other columns are ignored. A text is read whole by one task, in time that grows with
    its length; the trees take about 1 KB a word of a stretch that comes again and again.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                words = words_of(batch.column("text"), lower=False)
                hashes = words.hashes()
                where = stretches(hashes, words.first, periods, least)
                of = np.searchsorted(words.first, where.low, "right") - 1
                held: dict[int, list[np.ndarray]] = {}
                for text, low, high in zip(of.tolist(), where.low.tolist(), where.high.tolist(), strict=True):
                    runs = runs_of(hashes[low:high], periods, least)
                    if len(runs):
                        held.setdefault(text, []).append(runs + [low - words.first[text], 0, 0])
                for row, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                    runs = np.concatenate(held[row]) if row in held else np.empty((0, 3), np.int64)
                    listed = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
                    yield doc_id, listed, _collapsed((text or "").encode("utf-8", "surrogatepass").split(), runs)

        yield from batches_of(_RUNS, rows(), lambda r: 64 + 100 * len(r[1]) + len(r[2]))

    return docs.select("doc_id", "text").mapInArrow(find, _DDL)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one text of ten goes on periodically from some word on, both by a checksum of the id.

    With h the CRC-32 of the decimal ``doc_id``, g = h div 10 and n words, the texts with h mod 10 = 0 repeat the p words
    from word a = g mod n on, p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    changed = F.expr(
        "array_join(transform(sequence(0L, n - 1), i -> element_at(words, cast(if(i < a, i, a + (i - a) % p) + 1 as int))), ' ')"
    )
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words").cast("bigint")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The runs of the :func:`planted` texts in numbers: how many, the one with the most periods, and checksums.

    Per row ``doc_id``, ``n_runs``, ``start``, ``length``, ``period`` and ``exponent_milli`` of the run with the greatest
    length by period (ties: smallest start, then period; null without runs), ``runs_sha256`` and ``collapsed_sha256``.
    Null and empty texts and empty tables are as in :func:`periodic_runs`.
    """
    found = periodic_runs(planted(docs))
    best = F.expr(
        "aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0),"
        " (best, run) -> if(run.length * best.period > best.length * run.period, run, best))"
    )
    lines = F.expr("array_join(transform(runs, run -> concat(run.start, ',', run.length, ',', run.period, '\\n')), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
