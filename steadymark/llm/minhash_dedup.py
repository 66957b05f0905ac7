"""Near duplicates by MinHash with tensored banding.

Distinct shingle sets get two small collections of half keys, each of a few minhashes. A table key is a pair of
one half key of either collection, so m + m half keys stand for m * m tables and the minhashes for their square
root. Only half keys that two sets have can give a key that two sets have, so the others are not paired.

Sets that share a table key are tied to the least of them; what is tied together, directly or over others, is a
cluster that holds both ends of every candidate pair. Clusters are dealt to blocks of bounded size. A block
compares its full sets by an inverted index of their shingles, and only the links that join something leave it.
A cluster of several blocks is then joined over a sample of all its blocks, and the sets that are still apart
from its largest component, and only these, meet the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import Scratch, as_long, batches_of, bitmap, in_bitmap, keep, may_hold, mixed, release, scratch, shingles
from steadymark.llm.graph import components
from steadymark.llm.token_files import ddl
from steadymark.llm.word_streams import words_of

#: Words of a shingle, and the least share of common shingles, in hundredths.
WORDS, PERCENT = 5, 80
#: Minhashes of a half key; the number of half keys follows from the share and from :data:`MISSED`.
HALF = 4
#: Largest probability that a linked pair shares no table key.
MISSED = 1e-5
#: Sets and shingles of a block.
BLOCK_SETS, BLOCK_TOKENS = 4096, 1 << 21
#: Shingles that are hashed at a time.
STEP = 128
#: Rows of an Arrow batch of long columns.
LONGS = 1 << 17

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("halves", pa.binary())])
_TOKENS = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def half_keys(percent: int) -> int:
    """Half keys of a collection: a pair at the least share misses all keys with probability :data:`MISSED` at most."""
    same = (percent / 100) ** HALF
    count = 1
    while 1 - (1 - (1 - same) ** count) ** 2 > MISSED:
        count += 1
    return count


def sets_of(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a batch, ascending; fewer words than a shingle are one."""
    words = words_of(batch.column("text"))
    hashes = words.hashes()
    every = shingles(hashes, size)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = high - low
        if n < size:
            yield shingles(hashes[low:high], n) if n else np.empty(0, np.uint64)
            continue
        found = np.sort(every[low : high - size + 1])
        yield found[np.concatenate([[True], found[1:] != found[:-1]])]


class Sketch:
    """Half keys of sets: a minhash is the least of the shingles times an odd number."""

    def __init__(self, percent: int):
        self.count = half_keys(percent)
        self.factors = (mixed(np.arange(1, 2 * self.count * HALF + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.held = np.empty((STEP, len(self.factors)), np.uint32)
        self.place = mixed(np.arange(1, 2 * self.count + 1, dtype=np.uint64) + np.uint64(1 << 32))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        values = (tokens >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(values), STEP):
            part = values[at : at + STEP]
            product = np.multiply(part[:, None], self.factors, out=self.held[: len(part)])
            np.minimum(least, product.min(axis=0), out=least)
        halves = self.place.copy()
        for column in least.reshape(-1, HALF).T:
            halves = mixed(halves ^ column.astype(np.uint64))
        return halves


def sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row a document: its number of shingles, a signature of the set and the half keys of both collections."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(percent)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), sets_of(batch, size), strict=True):
                    n = len(tokens)
                    if not n:
                        yield doc_id, 0, None, None, None
                        continue
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(tokens.data), np.int64).tolist()
                    # A set so small that one shingle more breaks a link is linked with equal sets only.
                    alone = 100 * n < percent * (n + 1)
                    yield doc_id, n, a, b, None if alone else sketch.of(tokens).tobytes()

        yield from batches_of(_SETS, rows(), lambda r: 64 + len(r[4] or b""))

    return docs.select("doc_id", "text").mapInArrow(build, ddl(_SETS))


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2 * count)


def _longs(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), LONGS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + LONGS]) for c in columns], names=names)


def repeated_halves(sets: DataFrame, percent: int) -> np.ndarray:
    """A bitmap of the half keys that several sets have."""
    count = half_keys(percent)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if batch.num_rows:
                yield from _longs(["half"], [as_long(_matrix(batch.column("halves"), count).ravel())])

    found = sets.select("halves").mapInArrow(spread, "half bigint")
    return bitmap(found.groupBy("half").count().where("count > 1"), "half")


def table_keys(sets: DataFrame, percent: int, repeated: np.ndarray) -> DataFrame:
    """``key``, ``node``: every pair of a repeated half key of the one collection and one of the other."""
    count = half_keys(percent)
    shared = sets.sparkSession.sparkContext.broadcast(repeated)

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            halves = _matrix(batch.column("halves"), count)
            wanted = in_bitmap(shared.value, halves)
            nodes = batch.column("node").to_numpy()
            keys, owners = [], []
            for row in np.flatnonzero(wanted[:, :count].any(axis=1) & wanted[:, count:].any(axis=1)):
                left, right = halves[row, :count][wanted[row, :count]], halves[row, count:][wanted[row, count:]]
                keys.append(mixed(left[:, None] * np.uint64(3) + right[None, :]).ravel())
                owners.append(np.full(len(keys[-1]), nodes[row]))
            if keys:
                yield from _longs(["key", "node"], [as_long(np.concatenate(keys)), np.concatenate(owners)])

    return sets.select("node", "halves").mapInArrow(pair, "key bigint, node bigint")


class Roots(dict):
    """Union of nodes."""

    def of(self, node: int) -> int:
        while (above := self.get(node, node)) != node:
            self[node] = node = self.get(above, above)
        return node

    def join(self, a: int, b: int) -> bool:
        a, b = self.of(a), self.of(b)
        self[max(a, b)] = min(a, b)
        return a != b


class Block:
    """Sets and an inverted index of the shingles that several of them have."""

    def __init__(self, nodes: list[int], tokens: list[np.ndarray]):
        self.nodes = nodes
        self.sizes = np.array([len(t) for t in tokens])
        owners = np.repeat(np.arange(len(tokens), dtype=np.int32), self.sizes)
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        self.values, first = np.unique(every[order], return_index=True)
        self.owners, self.first = owners[order], np.append(first, len(every))

    def linked(self, tokens: np.ndarray, percent: int, below: int | None = None) -> np.ndarray:
        """Places of the sets (those before ``below``) that are linked with a set."""
        at = np.searchsorted(self.values, tokens)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == tokens]
        low, counts = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int64)
        places = np.arange(ends[-1]) + np.repeat(low - ends + counts, counts)
        common = np.bincount(self.owners[places], minlength=len(self.nodes))[:below]
        return np.flatnonzero(100 * common >= percent * (self.sizes[:below] + len(tokens) - common))


def _groups(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of sorted batches with their key (cluster, part): ``(key, row)``."""
    for batch in batches:
        for cluster, part, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", *columns)), strict=True):
            yield (cluster, part), row


def links_inside(rows: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: links that join the sets of each (cluster, part); what they connect is what all its links connect."""

    def of_block(held: list[tuple]) -> Iterator[tuple]:
        if len(held) < 2:
            return
        tokens = [np.frombuffer(data, np.uint64) for _, data in held]
        block, roots = Block([node for node, _ in held], tokens), Roots()
        for place, own in enumerate(tokens):
            for other in block.linked(own, percent, place).tolist():
                if roots.join(block.nodes[place], block.nodes[other]):
                    yield block.nodes[place], block.nodes[other]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            last, held = None, []
            for key, row in _groups(batches, "node", "tokens"):
                if key != last:
                    yield from of_block(held)
                    last, held = key, []
                held.append(row)
            yield from of_block(held)

        yield from batches_of(_EDGES, links())

    dealt = rows.select("cluster", "part", "node", "tokens").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "node")
    return dealt.mapInArrow(compare, ddl(_EDGES))


def links_between(rows: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: links of the rows with ``asks`` to the other rows of their (cluster, part), one for each pair of components."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            last, nodes, tokens, labels, block, roots = None, [], [], [], None, Roots()
            for key, (node, data, label, asks) in _groups(batches, "node", "tokens", "label", "asks"):
                if key != last:
                    last, nodes, tokens, labels, block, roots = key, [], [], [], None, Roots()
                own = np.frombuffer(data, np.uint64)
                if not asks:
                    nodes.append(node)
                    tokens.append(own)
                    labels.append(label)
                    continue
                if not nodes:
                    continue
                block = block or Block(nodes, tokens)
                for other in block.linked(own, percent).tolist():
                    if roots.join(label, labels[other]):
                        yield node, nodes[other]

        yield from batches_of(_EDGES, links())

    dealt = rows.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "asks", "node")
    return dealt.mapInArrow(compare, ddl(_EDGES))


def _sampled(rows: DataFrame) -> DataFrame:
    """About one block of sets of each cluster of several blocks, from all of them."""
    chosen = rows.where((F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit("sample")), "parts") == 0))
    return chosen.withColumn("part", F.lit(-1).cast("bigint"))


def across(s: Scratch, rows: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """``edges`` and the links between blocks of a cluster that are needed to connect what all links connect."""
    wide = rows.where("parts > 1")
    if wide.isEmpty():
        return edges
    edges = s.cut(edges.union(links_inside(_sampled(wide), percent)))
    labelled = wide.join(components(s, edges), F.col("node") == F.col("id"), "left").select(*wide.columns, F.coalesce("label", "node").alias("label"))
    labelled = s.cut(labelled)
    sizes = labelled.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    asking = labelled.join(largest, "cluster").where("label != main").drop("main")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda part: part != F.col("part")))
    columns = ["cluster", "part", "node", "tokens", "label"]
    sent = asking.withColumn("other", others).withColumn("part", F.col("other")).select(*columns, F.lit(1).alias("asks"))
    return s.cut(edges.union(links_between(labelled.select(*columns, F.lit(0).alias("asks")).union(sent), percent)))


def tokens_of(docs: DataFrame, size: int) -> DataFrame:
    """``node``, ``tokens``: the whole shingle sets of documents."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((doc_id, tokens.tobytes()) for batch in batches for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), sets_of(batch, size), strict=True) if len(tokens))
        yield from batches_of(_TOKENS, found, lambda r: 16 + len(r[1]))

    return docs.mapInArrow(build, ddl(_TOKENS))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Two texts are linked when at least ``percent`` hundredths of the shingles of either are shingles of both;
    a component has all documents that links connect, is named by its least ``doc_id``, and that one is kept.
    Pairs are found by table keys: one that is just linked is missed with probability 1e-5, a closer one less
    often; every link that counts was confirmed on the whole sets. Words are parted by ASCII white space, A-Z
    lower-cased. A null or empty text, or one without words, has no shingles and is a component of its own; texts
    of any length are read whole. Rows that repeat a ``doc_id`` are one document, linked by whichever of their
    texts; a null ``doc_id`` is linked with nothing and kept. An empty table gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as s:
        sets = s.cut(sketched(docs, words, percent))
        signature = ["sig_a", "sig_b"]
        some = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        named = s.cut(some.groupBy(*signature).agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves")))
        distinct = named.where(F.col("halves").isNotNull())
        keys = s.cut(table_keys(distinct, percent, repeated_halves(distinct, percent)))
        tables = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").drop("last")
        near = keys.join(tables, "key").where("node != lead").select("node", "lead").distinct()
        clusters = components(s, near)
        sizes = named.groupBy("node").agg(F.max("n").alias("n"))
        placed = s.cut(clusters.join(sizes, F.col("id") == F.col("node")).select("node", F.col("label").alias("cluster"), "n"))
        extents = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_tokens)).alias("parts"))
        placed = placed.join(extents, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("n")
        texts = may_hold(docs.select("doc_id", "text"), "doc_id", bitmap(placed, "node"))
        rows = s.cut(tokens_of(texts, words).join(placed, "node"))
        edges = across(s, rows, s.cut(links_inside(rows, percent)), percent)
        own = some.join(named.select(*signature, "node"), signature).select("doc_id", "node")
        least = own.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most")
        tied = own.join(least, "doc_id").select("node", "least")
        labels = s.cut(components(s, edges.union(tied)))
        held = sets.select("doc_id", F.col("n").alias("n_shingles"), *signature).join(named.select(*signature, "node"), signature, "left")
        node = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
        found = held.withColumn("node", node).join(labels, F.col("node") == F.col("id"), "left")
        found = found.select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
        return keep(found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
