"""Phrases that stand together by counts in weighted acyclic automata.

Each task counts the n-grams of its texts and builds transducers from the sorted ones: a path of words has its count as
weight, equal endings are one state. Transducers are dealt by ranges of the first words; those of a range are united, the
weights of equal paths summed, and paths below the least count dropped. Lengths are counted in turn, so that an n-gram is
only looked at if its words, then its pairs, are frequent: no phrase is more frequent than its parts. The parts of a
phrase are looked up by composing the transducer of a range with the parts asked for there.

A word is a 64-bit hash of itself and its language; the words of the phrases that are returned are read again at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadymark.llm.common import Scratch, as_long, bitmap, in_bitmap, keep, mixed, release, scratch
from steadymark.llm.word_streams import Words, byte_set, words_of

#: Least count of a phrase, longest phrase in words, phrases of a language that are returned.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this share of its count, in hundredths.
HELD = 80
#: n-grams that a task holds before it builds transducers of them, and words after which it hands their counts on.
SHARD, VOCABULARY = 1 << 20, 1 << 19
#: Words of the texts for each prefix range, about.
RANGE = 1 << 19
#: The language of texts without one.
UNKNOWN = "und"

#: Characters that end a piece, and blanks between words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS, _BREAKS = byte_set(ENDS), byte_set(ENDS + GAPS)

_PATHS = "cell bigint, paths binary"
_COUNTED = "w1 bigint, w2 bigint, w3 bigint, w4 bigint, size int, f bigint"
_WORDS = ["w1", "w2", "w3", "w4"]


# ---------------------------------------------------------------- transducers


def _spread(first: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``groups`` the places ``first[g]`` to ``first[g + 1]``, and how many."""
    counts = first[groups + 1] - first[groups]
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[groups] - ends + counts, counts), counts


@dataclass
class Level:
    """Arcs from the states of one depth: those of state s are ``first[s]`` to ``first[s + 1]``, by rising label.

    The weight of an arc is the count of the path it ends (0: none), its target a state of the next depth (-1: none).
    """

    first: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray


class Transducer:
    """A weighted acyclic automaton of paths of up to four words; its root is state 0 of the first level."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def of(cls, paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """Of sorted paths without repeats (rows of labels; 0 follows a shorter path), the last level first: states with
        the same arcs are one."""
        depth = paths.shape[1]
        new = np.ones(paths.shape, bool)
        new[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        ends = (paths != 0).sum(axis=1)
        arcs = [np.flatnonzero(new[:, d] & (paths[:, d] != 0)) for d in range(depth)]
        levels: list[Level] = []
        targets = np.full(len(arcs[-1]), -1)
        for d in range(depth - 1, -1, -1):
            rows = arcs[d]
            labels = paths[rows, d]
            own = np.where(ends[rows] == d + 1, weights[rows], 0)
            parents = np.searchsorted(arcs[d - 1], rows, "right") - 1 if d else np.zeros(len(rows), np.int64)
            opens = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(rows) else np.empty(0, np.int64)
            first = np.append(opens, len(rows))
            if not len(rows):
                levels.append(Level(np.zeros(1, np.int64), labels, own, targets))
                targets = np.full(len(arcs[d - 1]), -1)
                continue
            place = (np.arange(len(rows)) - np.repeat(opens, np.diff(first))).astype(np.uint64)
            mark = mixed(labels + mixed(own.astype(np.uint64) * np.uint64(3) + mixed(targets.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15))))
            _, chosen, state = np.unique(np.add.reduceat(mark, opens), return_index=True, return_inverse=True)
            at, counts = _spread(first, chosen)
            levels.append(Level(np.concatenate([[0], np.cumsum(counts)]), labels[at], own[at], targets[at]))
            if d:
                targets = np.full(len(arcs[d - 1]), -1)
                targets[parents[opens]] = state
        return cls(levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths with a weight, and the weights."""
        depth = len(self.levels)
        rows, weights = [], []
        prefix, state = np.empty((1, 0), np.uint64), np.zeros(1, np.int64)
        for d, level in enumerate(self.levels):
            at, counts = _spread(level.first, state)
            prefix = np.column_stack([np.repeat(prefix, counts, axis=0), level.labels[at]])
            some = level.weights[at] > 0
            found = np.zeros((int(some.sum()), depth), np.uint64)
            found[:, : d + 1] = prefix[some]
            rows.append(found)
            weights.append(level.weights[at][some])
            on = level.targets[at] >= 0
            prefix, state = prefix[on], level.targets[at][on]
        return np.concatenate(rows), np.concatenate(weights)

    def weights_of(self, asked: np.ndarray) -> np.ndarray:
        """The composition with paths of one length: their weights, 0 where there is no such path."""
        state, weight = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for d in range(asked.shape[1]):
            level, label = self.levels[d], asked[:, d]
            safe = np.maximum(state, 0)
            low, end = level.first[safe], np.where(state >= 0, level.first[safe + 1], level.first[safe])
            high = end.copy()
            while (low < high).any():  # a binary search in each row's state
                middle = (low + high) // 2
                less = (low < high) & (level.labels[np.minimum(middle, len(level.labels) - 1)] < label)
                high = np.where((low < high) & ~less, middle, high)
                low = np.where(less, middle + 1, low)
            at = np.minimum(low, max(len(level.labels) - 1, 0))
            found = (low < end) & (level.labels[at] == label) if len(level.labels) else np.zeros(len(asked), bool)
            weight = np.where(found, level.weights[at], 0) if len(level.labels) else np.zeros(len(asked), np.int64)
            state = np.where(found, level.targets[at], -1) if len(level.labels) else np.full(len(asked), -1)
        return weight

    def to_bytes(self) -> bytes:
        """The sizes of all levels and their arrays, numbers in 32 bits where they fit."""
        parts: list[bytes] = [np.array([len(self.levels), *(n for v in self.levels for n in (len(v.first), len(v.labels)))], np.int64).tobytes()]
        for level in self.levels:
            wide = np.int64 if len(level.weights) and level.weights.max() >= 1 << 31 else np.int32
            parts += [np.array([wide is np.int64], np.int8).tobytes(), level.first.astype(np.int32).tobytes(), level.labels.tobytes(), level.weights.astype(wide).tobytes(), level.targets.astype(np.int32).tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, 2 * depth, 8).reshape(depth, 2).tolist()
        at = 8 + 16 * depth
        levels = []
        for states, arcs in sizes:
            wide = np.int64 if data[at] else np.int32
            at += 1
            arrays = []
            for kind, count in ((np.int32, states), (np.uint64, arcs), (wide, arcs), (np.int32, arcs)):
                arrays.append(np.frombuffer(data, kind, count, at))
                at += arrays[-1].nbytes
            levels.append(Level(arrays[0].astype(np.int64), arrays[1], arrays[2].astype(np.int64), arrays[3].astype(np.int64)))
        return cls(levels)


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths in order without repeats, with the sums of their weights."""
    order = np.lexsort(paths.T[::-1])
    paths, weights = paths[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(axis=1)]))
    return paths[first], np.add.reduceat(weights, first)


def united(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The paths of several transducers with the sums of their weights."""
    both = [part.paths() for part in parts]
    return summed(np.concatenate([p for p, _ in both]), np.concatenate([w for _, w in both]))


# ---------------------------------------------------------------- texts


@dataclass
class Stream:
    """Words of a batch: ``hashes`` by language, ``tied[i]`` if word i + 1 follows word i in one piece."""

    words: Words
    hashes: np.ndarray
    tied: np.ndarray
    language: np.ndarray
    names: list[str]


def stream(batch: pa.RecordBatch) -> Stream:
    words = words_of(batch.column("text"), _BREAKS)
    coded = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
    language = coded.indices.to_numpy()[text] if len(text) else np.empty(0, np.int64)
    salts = np.array([xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) for name in names], np.uint64)
    hashes = mixed(words.hashes() + salts[language]) if len(text) else np.empty(0, np.uint64)
    pieces = np.cumsum(_ENDS[words.data], dtype=np.int32)
    at = pieces[words.starts]
    tied = (at[1:] == at[:-1]) & (text[1:] == text[:-1])
    return Stream(words, hashes, tied, language, names)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``w``, ``f``: how often each word stands; all words of a language under a null ``w``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                words, weights = summed(np.concatenate([w for w, _ in parts])[:, None], np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(words) + 1)), pa.array([None, *as_long(words.ravel()).tolist()], pa.int64()), pa.array(np.append(weights.sum(), weights))],
                    names=["lang", "w", "f"],
                )
            held.clear()

        release()
        for batch in batches:
            found = stream(batch)
            for code, name in enumerate(found.names):
                words, counts = np.unique(found.hashes[found.language == code], return_counts=True)
                if len(words):
                    held.setdefault(name, []).append((words, counts))
                    size += len(words)
            if size >= VOCABULARY:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(count, "lang string, w bigint, f bigint").groupBy("lang", "w").agg(F.sum("f").alias("f"))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(3) + mixed(second))


def cells(paths: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """The prefix range of each path: ``bits`` leading bits of each of its first ``depth`` labels."""
    cell = np.zeros(len(paths), np.int64)
    for label in paths[:, :depth].T:
        cell = cell << bits | (label >> np.uint64(64 - bits)).astype(np.int64)
    return cell


def _transducers(rows: np.ndarray, depth: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A transducer of each prefix range of a task's n-grams."""
    key = np.zeros(len(rows), np.uint64)
    for label in rows.T:
        key = mixed(key * np.uint64(3) + label)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    rows = rows[first]
    cell = cells(rows, depth, bits)
    order = np.lexsort([*rows.T[::-1], cell])
    rows, counts, cell = rows[order], counts[order], cell[order]
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    made = [(int(cell[a]), Transducer.of(rows[a:b], counts[a:b]).to_bytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for at in range(0, len(made), 256):
        numbers, data = zip(*made[at : at + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], names=["cell", "paths"])


def shards(docs: DataFrame, frequent: np.ndarray, pairs: bool, bits: int) -> DataFrame:
    """``cell``, ``paths``: transducers of the pairs whose words may be frequent, or of the n-grams of three and four
    words whose pairs may be."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        release()
        for batch in batches:
            found = stream(batch)
            words = found.hashes
            if pairs:
                some = in_bitmap(shared.value, words)
                at = np.flatnonzero(found.tied & some[1:] & some[:-1])
                held.append(np.stack([words[at], words[at + 1]], axis=1))
            else:
                some = found.tied & in_bitmap(shared.value, pair_keys(words[:-1], words[1:]))
                for length in (3, 4):
                    run = some[: len(some) - length + 2].copy()
                    for step in range(1, length - 1):
                        run &= some[step : step + len(run)]
                    at = np.flatnonzero(run)
                    held.append(np.stack([words[at + i] if i < length else np.zeros(len(at), np.uint64) for i in range(4)], axis=1))
            size += sum(map(len, held[-2:]))
            if size >= SHARD:
                yield from _transducers(np.concatenate(held), 2 if pairs else 3, bits)
                held, size = [], 0
        if size:
            yield from _transducers(np.concatenate(held), 2 if pairs else 3, bits)

    return docs.mapInArrow(build, _PATHS)


def counted(parts: DataFrame, least: int) -> DataFrame:
    """The paths of all transducers of a prefix range with the sums of their weights, from ``least`` on."""

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_range(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            paths, weights = united([Transducer.from_bytes(data) for data in held])
            enough = weights >= least
            paths, weights = paths[enough], weights[enough]
            size = (paths != 0).sum(axis=1)
            wide = np.zeros((len(paths), LONGEST), np.uint64)
            wide[:, : paths.shape[1]] = paths
            columns = [pa.array(as_long(np.ascontiguousarray(wide[:, i])), mask=size <= i) for i in range(LONGEST)]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(size.astype(np.int32)), pa.array(weights)], names=[*_WORDS, "size", "f"])
            for at in range(0, len(paths), 1 << 16):
                yield batch.slice(at, 1 << 16)

        release()
        last, held = None, []
        for batch in batches:
            for cell, data in zip(batch.column("cell").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                if cell != last:
                    yield from of_range(held)
                    last, held = cell, []
                held.append(data)
        yield from of_range(held)

    return parts.repartition("cell").sortWithinPartitions("cell").mapInArrow(unite, _COUNTED)


# ---------------------------------------------------------------- phrases


def key_of(first: int, last: int) -> Column:
    """The key of the words ``first`` to ``last`` (from 1) of a phrase; null words at its end do not change a key."""
    return F.xxhash64(*[F.col(w) for w in _WORDS[first - 1 : last]])


def composed(counts: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """``key``, ``f`` of the phrases ``asked`` for: in each prefix range and length the transducer of the counted
    phrases is composed with those asked for."""
    label = lambda w: F.shiftrightunsigned(F.coalesce(w, F.lit(0).cast("bigint")), 64 - bits)
    cell = sum((label(w) * F.lit(1 << (bits * i)).cast("bigint") for i, w in enumerate(_WORDS[:3])), F.lit(0).cast("bigint"))
    columns = ["size", *_WORDS]
    both = counts.select(*columns, "f").union(asked.select(*columns, F.lit(-1).cast("bigint")).distinct())
    dealt = both.withColumn("cell", cell).repartition("cell", "size").sortWithinPartitions("cell", "size")

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_range(size: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = np.array([row[:size] for row in held], np.int64).astype(np.uint64) if held else np.empty((0, size), np.uint64)
            weights = np.array([row[-1] for row in held], np.int64)
            is_asked = weights < 0
            if not is_asked.any() or is_asked.all():
                return
            found = Transducer.of(*summed(rows[~is_asked], weights[~is_asked])).weights_of(rows[is_asked])
            asked = rows[is_asked][found > 0]
            nothing = pa.nulls(len(asked), pa.int64())
            columns = [pa.array(as_long(np.ascontiguousarray(asked[:, i]))) if i < size else nothing for i in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(asked), size, np.int32)), pa.array(found[found > 0])], names=[*_WORDS, "size", "f"])

        last, held = None, []
        for batch in batches:
            for cell, size, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "size", *_WORDS, "f")), strict=True):
                if (cell, size) != last:
                    yield from of_range(last[1] if last else 0, held)
                    last, held = (cell, size), []
                held.append(row)
        yield from of_range(last[1] if last else 0, held)

    return dealt.mapInArrow(look_up, _COUNTED).select(key_of(1, LONGEST).alias("key"), "f")


def _parts(size: int) -> list[tuple[int, int, int]]:
    """(k, first, last): both sides of each cut of a phrase after k words."""
    return [(k, a, b) for k in range(1, size) for a, b in ((1, k), (k + 1, size))]


def asked_parts(phrases: DataFrame) -> DataFrame:
    """The words and lengths of all parts of ``phrases``."""
    none = F.lit(None).cast("bigint")

    def part(first: int, last: int) -> Column:
        words = [F.col(w) for w in _WORDS[first - 1 : last]]
        return F.struct(F.lit(last - first + 1).alias("size"), *[(words[i] if i < len(words) else none).alias(w) for i, w in enumerate(_WORDS)])

    of = [F.when(F.col("size") == n, F.array(*[part(a, b) for _, a, b in _parts(n)])) for n in range(2, LONGEST + 1)]
    return phrases.select(F.inline(F.coalesce(*of)))


def scored(phrases: DataFrame, weights: DataFrame) -> DataFrame:
    """``phrases`` with ``l``, ``r`` and ``score`` of the cut that scores lowest (ties: the first)."""

    def cuts(size: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), key_of(1, k).alias("left"), key_of(k + 1, size).alias("right")) for k in range(1, size)])

    of = [F.when(F.col("size") == n, cuts(n)) for n in range(2, LONGEST + 1)]
    cut = phrases.select("key", "f", F.inline(F.coalesce(*of)))
    left, right = (weights.select(F.col("key").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    known = cut.join(left, "left").join(right, "right")
    score = F.expr("cast((cast(2000000 as decimal(19, 0)) * cast(f as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)")
    lowest = known.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("lowest"))
    return phrases.join(lowest, "key").select(*phrases.columns, "lowest.l", "lowest.r", "lowest.score")


def not_held(phrases: DataFrame, percent: int) -> DataFrame:
    """``phrases`` without those inside a longer one with ``percent`` hundredths of their count."""

    def inner(size: int) -> Column:
        return F.array(*[key_of(a, a + n - 1) for n in range(2, size) for a in range(1, size - n + 2)])

    of = [F.when(F.col("size") == n, inner(n)) for n in range(3, LONGEST + 1)]
    longer = phrases.where("size > 2").select(F.explode(F.coalesce(*of)).alias("held"), F.col("f").alias("of"))
    most = longer.groupBy("held").agg(F.max("of").alias("of"))
    gone = F.coalesce(F.lit(100).cast("decimal(19, 0)") * F.col("of") >= F.lit(percent).cast("decimal(19, 0)") * F.col("f"), F.lit(False))
    return phrases.join(most, F.col("key") == F.col("held"), "left").where(~gone).select(*phrases.columns)


def spelled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``w``, ``word`` of the words whose hashes are in column ``w`` of ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "w"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        release()
        for batch in batches:
            found = stream(batch)
            at = np.flatnonzero(in_bitmap(shared.value, found.hashes))
            hashes, first = np.unique(found.hashes[at], return_index=True)
            new = [(h, p) for h, p in zip(as_long(hashes).tolist(), at[first].tolist(), strict=True) if h not in seen]
            seen.update(h for h, _ in new)
            if len(seen) > VOCABULARY:
                seen.clear()
            if new:
                words = [found.words.of(p).decode("utf-8", "replace") for _, p in new]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in new], pa.int64()), pa.array(words)], names=["w", "word"])

    return docs.mapInArrow(read, "w bigint, word string").groupBy("w").agg(F.min("word").alias("word")).join(wanted, "w", "left_semi")


def _phrases(s: Scratch, docs: DataFrame, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Scored phrases that no longer one holds, and the frequent words with the totals of languages."""
    words = s.cut(word_counts(docs).where((F.col("f") >= least) | F.col("w").isNull()))
    frequent = words.where("w is not null")
    total = words.where("w is null").agg(F.sum("f")).first()[0] or 0
    bits = max(2, (total // RANGE).bit_length() // 2)
    two = s.cut(counted(shards(docs, bitmap(frequent, "w"), True, bits), least))
    pairs = two.select("w1", "w2").mapInArrow(_pair_keys, "pair bigint")
    # A third label divides a range again: as many ranges in all need fewer bits of each.
    more = s.cut(counted(shards(docs, bitmap(pairs, "pair"), False, max(2, 2 * bits // 3)), least))
    phrases = two.union(more).withColumn("key", key_of(1, LONGEST))
    none = F.lit(None).cast("bigint")
    single = frequent.select(F.col("w").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4"), F.lit(1).alias("size"), "f")
    weights = s.cut(composed(single.union(two).union(more), asked_parts(phrases), max(2, 2 * bits // 3)))
    return s.cut(not_held(scored(phrases, weights), percent)), words


def _pair_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(as_long(pair_keys(first, second)))], names=["pair"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = HELD) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are parted into pieces at ``.,;:!?`` and line ends and these into words at blanks and tabs, A-Z lower-cased. ``n`` counts
    all words of a language, ``a`` the occurrences of a phrase of two to four words within pieces, at least
    ``least``. Cut after its first k words its parts have counts ``l`` and ``r`` and the cut scores
    floor(2000000 a / (l + r)); the lowest scoring cut counts (ties: the first). A phrase inside a longer one of at
    least ``least`` occurrences and ``percent`` hundredths of its own goes. Order: falling score, falling ``a``,
    phrase by bytes. A null language is ``und``; a null or empty text has no words. Rows with one id are texts of their
    own, ids are not read; an empty table, and a language without such phrases, give no rows. Texts of any length are
    read whole. Other columns are ignored.
    """
    docs = docs.select("text", "lang")
    with scratch(docs.sparkSession) as s:
        phrases, words = _phrases(s, docs, least, percent)
        order = [F.desc("score"), F.desc("a")]
        totals = words.where("w is null").select("lang", F.col("f").alias("n"))
        languages = words.where("w is not null").select(F.col("w").alias("w1"), "lang")
        named = phrases.withColumnRenamed("f", "a").join(languages, "w1")
        # Ties stay: the phrases themselves order them once their words are known.
        first = named.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
        first = s.cut(first.drop("place"))
        wanted = first.select(F.explode(F.array(*_WORDS)).alias("w")).where("w is not null").distinct()
        spelling = s.cut(spelled(docs, wanted))
        for w in _WORDS:
            first = first.join(spelling.select(F.col("w").alias(w), F.col("word").alias(f"{w}_word")), w, "left")
        rows = first.withColumn("phrase", F.concat_ws(" ", *[f"{w}_word" for w in _WORDS]))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint")
        ranked = rows.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
        return keep(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
