"""N-gram Jaccard join by a token-group matrix.

Documents become sets of shingle hashes; equal sets are one. Similar sets are partitioned into groups: sets
that share their least shingle are compared in bounded blocks, and what links connect there is a cluster, dealt to
groups of bounded size. The matrix is stored by token: which groups have it among the tokens that a member must
share with any set linked to it. A set looks its own such tokens up and counts those it shares with a group, which
bounds its overlap with each member. Of two clusters the sets of the smaller one ask the groups of the larger, so a
large group of near copies is asked and does not ask. Groups that may hold a linked set are read; the overlap with
the union of all of a group's tokens bounds it again, and only if that suffices is the group opened and its members
compared. Members of one cluster are known to be connected, so one link between two clusters is enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import SMALL_ROWS, Scratch, as_long, batches_of, bitmap, in_bitmap, keep, may_hold, mixed, release, scratch, shingles
from steadymark.llm.graph import components
from steadymark.llm.minhash_dedup import Block, Roots, sets_of
from steadymark.llm.token_files import ddl

#: Words of a shingle, and the least share of common shingles, in hundredths.
WORDS, PERCENT = 5, 80
#: Sets and shingles of a group, and of a block of sets with one least token.
GROUP_SETS, GROUP_TOKENS = 2048, 1 << 20
#: Sets with one least token are dealt to so many parts if they are more than a group times the parts before.
PARTS = (64, 4096, 1 << 18)
#: Passes over the sets that stay apart in keys of several parts.
PASSES = 3
#: Groups that may have a token before it is put last in the order of tokens.
FREQUENT = 32
#: Bits of the bitmap that says which tokens are frequent.
FREQUENT_BITS = 1 << 22
#: Rounds of looking for frequent tokens among those that replace others.
ROUNDS = 4

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("low", pa.int64()), ("tokens", pa.binary())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_POSTINGS = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cluster", pa.int64()), ("chunk", pa.int64()), ("members", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])


def side(df: DataFrame) -> DataFrame:
    """A narrow side of a join, sent to all tasks if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def tokens_of(words: np.ndarray, size: int) -> np.ndarray:
    """The set of shingles in ascending order; fewer words than a shingle are one."""
    return np.unique(shingles(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """One row a document: its number of shingles, a signature of the set, the least shingle and all shingles."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), sets_of(batch, size), strict=True):
                    if not len(tokens):
                        yield doc_id, 0, None, None, None, None
                        continue
                    data = tokens.tobytes()
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist()
                    yield doc_id, len(tokens), a, b, int(as_long(tokens[:1])[0]), data

        yield from batches_of(_SETS, rows(), lambda r: 64 + 8 * r[1])

    return docs.select("doc_id", "text").mapInArrow(build, ddl(_SETS))


def lead(sets: DataFrame, percent: int, repeated: np.ndarray, hot: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``u``, ``v``: links that join sets with the same least token, one of the ``repeated`` keys.

    Sets are read in order, a key at a time, in blocks of bounded sets and tokens. ``hot`` has numbers of parts and the
    keys that are dealt to so many. One worker a task picks and deals the sets: each one more would hold its memory.
    """
    shared = sets.sparkSession.sparkContext.broadcast((repeated, hot))

    def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            repeated, hot = shared.value
            batch = batch.filter(pa.array(in_bitmap(repeated, batch.column("low").to_numpy())))
            low, place = batch.column("low").to_numpy(), mixed(batch.column("doc_id").to_numpy().view(np.uint64))
            part = np.zeros(batch.num_rows, np.int64)
            for parts, keys in hot:
                part = np.where(in_bitmap(keys, low), (place % np.uint64(parts)).astype(np.int64), part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("low"), pa.array(part), batch.column("tokens")], names=["doc_id", "low", "part", "tokens"])

    def block_links(ids: list[int], tokens: list[np.ndarray]) -> Iterator[tuple]:
        if len(ids) < 2:
            return
        block, roots = Block(ids, tokens), Roots()
        for place, own in enumerate(tokens):
            for other in block.linked(own, percent, place).tolist():
                if roots.join(ids[place], ids[other]):
                    yield ids[place], ids[other]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, ids, tokens, held = None, [], [], 0
            for batch in batches:
                for doc_id, low, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (low, part) != last or len(ids) >= GROUP_SETS or held >= GROUP_TOKENS:
                        yield from block_links(ids, tokens)
                        last, ids, tokens, held = (low, part), [], [], 0
                    ids.append(doc_id)
                    tokens.append(np.frombuffer(data, np.uint64))
                    held += len(tokens[-1])
            yield from block_links(ids, tokens)

        yield from batches_of(_EDGES, rows())

    keyed = sets.mapInArrow(parted, "doc_id bigint, low bigint, part bigint, tokens binary")
    return keyed.repartition("low", "part").sortWithinPartitions("low", "part", "doc_id").mapInArrow(compare, ddl(_EDGES))


def grouped(s: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """Links between similar sets, whose components become groups.

    What is still apart after a pass in a key of several parts is dealt anew; links that all passes leave out are found
    by the matrix.
    """
    edges, left = None, sets
    for _ in range(PASSES):
        keys = s.cut(left.groupBy("low").count().where("count > 1"))
        hot = [(parts, keys.where(F.col("count") > GROUP_SETS * before)) for before, parts in zip((1, *PARTS), PARTS, strict=False)]
        crowded = hot[0][1].select("low")  # a key a group of sets at most
        hot = [(parts, bitmap(found, "low")) for parts, found in hot if not found.isEmpty()]
        found = s.cut(lead(left, percent, bitmap(keys, "low"), hot))
        edges = found if edges is None else edges.union(found)
        if not hot:
            break
        tied = components(s, found).where("id != label").select(F.col("id").alias("doc_id"))
        left = left.join(side(crowded), "low", "left_semi").join(side(tied), "doc_id", "left_anti").select(*sets.columns)
    return s.cut(edges)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Any set linked to one of n tokens has one of its first so many, in any order of tokens that all share."""
    return n - (-(-percent * n // 100)) + 1


def prefixes(sets: DataFrame, percent: int, frequent: np.ndarray, common: np.ndarray | None, only_new: bool) -> DataFrame:
    """The tokens of each set that it must share with any set linked to it: frequent ones last, else by value.

    With ``common``, tokens that are known to be in no other set's prefix are left out. ``only_new`` gives those that
    are there only because frequent ones went last.
    """
    context = sets.sparkSession.sparkContext
    shared, known = context.broadcast(frequent), context.broadcast(common)

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            parts, rows = [], []
            for i, data in enumerate(batch.column("tokens")):
                tokens = np.frombuffer(data.as_py(), np.uint64)
                need = prefix_length(len(tokens), percent)
                last = in_bitmap(shared.value, tokens)
                order = np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])[:need]
                if only_new:
                    order = order[order >= need]
                elif known.value is not None:
                    order = order[in_bitmap(known.value, tokens[order])]
                parts.append(as_long(tokens[order]))
                rows.append(np.full(len(order), i))
            if not parts:
                continue
            row = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(parts)), *(batch.column(name).take(row) for name in _POSTINGS.names[1:])]
            for at in range(0, len(row), 1 << 18):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 18) for c in columns], schema=_POSTINGS)

    return sets.mapInArrow(pick, ddl(_POSTINGS))


def candidates(s: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id``, ``cluster``, ``chunk``: sets and the groups of other clusters, not smaller than theirs, they may be linked to."""
    leads = F.sum((F.col("doc_id") == F.col("cluster")).cast("int")).alias("leads")
    none = np.zeros(1, np.uint64)
    counted = s.cut(prefixes(sets, percent, none, None, False).groupBy("token").agg(F.count("*").alias("n"), leads).where("n > 1"))
    frequent = bitmap(counted.where(F.col("leads") > FREQUENT), "token", FREQUENT_BITS)
    for _ in range(ROUNDS):
        new = prefixes(sets, percent, frequent, None, True).groupBy("token").agg(leads).where(F.col("leads") > FREQUENT)
        more = bitmap(new, "token", FREQUENT_BITS)
        if not (more & ~frequent).any():
            break
        frequent |= more
    # A token is looked up unless one first prefix alone has it and none got it because frequent ones went last.
    added = prefixes(sets, percent, frequent, None, True).select("token").distinct()
    common = bitmap(s.cut(counted.select("token").union(added)), "token")
    matrix = prefixes(sets, percent, frequent, common, False).repartition("token")
    groups = matrix.select("token", F.col("cluster").alias("of"), F.col("chunk").alias("part"), F.col("members").alias("of_members"), F.col("least").alias("low"), F.col("most").alias("high")).distinct()
    fits = (100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n"))
    counted = matrix.join(groups, "token").where((F.struct("members", "cluster") < F.struct("of_members", "of")) & fits).groupBy("doc_id", "n", "of", "part", "low", "high").agg(F.count("*").alias("common"))
    return counted.where(F.col("common") >= least_common(percent)).select("doc_id", F.col("of").alias("cluster"), F.col("part").alias("chunk")).distinct()


def least_common(percent: int) -> Column:
    """How many prefix tokens a set of ``n`` shares at least with the union of a group if it is linked to a member.

    Of a link's common tokens, those beyond the prefix of the set whose prefix ends first are no more than the
    rest of that set; the others are in both prefixes. Members have ``low`` to ``high`` tokens, of which the set
    may be linked to those of a near size; the bound is least at one end, 1 is taken off for rounding.
    """
    n = F.col("n")
    rest = lambda size: F.ceil(percent * size / 100) - 1
    bound = lambda size: F.ceil(percent * (n + size) / (100 + percent)) - F.greatest(rest(n), rest(size)) - 1
    return F.greatest(F.lit(1), F.least(bound(F.greatest("low", F.ceil(percent * n / 100))), bound(F.least("high", F.floor(100 * n / percent)))))


def may_link(group: Block, tokens: np.ndarray, percent: int) -> bool:
    """Whether a set shares so many tokens with the union of a group that it may be linked to a member.

    A member of m tokens needs percent * (n + m) / (100 + percent) common ones, and m >= percent * n / 100.
    """
    n = len(tokens)
    at = np.searchsorted(group.values, tokens)
    at[at == len(group.values)] = 0
    least = max(int(group.sizes.min()), -(-percent * n // 100))
    return int((group.values[at] == tokens).sum()) >= -(-percent * (n + least) // (100 + percent))


def opened(s: Scratch, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: links between sets and members of their candidate groups, one for each cluster and group at least."""
    groups = found.select("cluster", "chunk").distinct()
    members = sets.select("doc_id", "cluster", "chunk").join(side(groups), ["cluster", "chunk"], "left_semi").distinct()
    wanted = s.cut(members.select("doc_id", "cluster", "chunk", F.lit(0).alias("kind")).union(found.select("doc_id", "cluster", "chunk", F.lit(1))))
    read = may_hold(sets.select("doc_id", F.col("cluster").alias("own"), "tokens"), "doc_id", bitmap(wanted, "doc_id"))
    # Where a set goes is settled on narrow rows, so that its tokens are dealt once.
    going = read.join(side(wanted), "doc_id").select("cluster", "chunk", "kind", "doc_id", "own", "tokens")
    rows = going.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "kind", "doc_id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            key, ids, members, group, joined = None, [], [], None, set()
            for batch in batches:
                for cluster, chunk, kind, doc_id, own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (cluster, chunk) != key:
                        key, ids, members, group, joined = (cluster, chunk), [], [], None, set()
                    tokens = np.frombuffer(data, np.uint64)
                    if kind == 0:
                        ids.append(doc_id)
                        members.append(tokens)
                        continue
                    if own in joined:
                        continue
                    group = group or Block(ids, members)
                    if not may_link(group, tokens, percent):
                        continue
                    hits = group.linked(tokens, percent)
                    if len(hits):
                        joined.add(own)
                        yield doc_id, ids[hits[0]]

        yield from batches_of(_EDGES, links())

    return rows.mapInArrow(compare, ddl(_EDGES))


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Two texts are linked when at least ``percent`` hundredths of the shingles of either are shingles of both;
    a component has all documents that links connect, and is named by its least ``doc_id``. Words are parted
    by ASCII white space, A-Z lower-cased. A null or empty text, or one without words, has no shingles and
    is a component of its own. Rows that repeat a ``doc_id`` are one document, linked by whichever of their
    texts; a null ``doc_id`` is linked with nothing. An empty table gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as s:
        sets = s.cut(token_sets(docs, words))
        some = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        signature = ["sig_a", "sig_b"]
        named = s.cut(some.groupBy(*signature).agg(F.min("doc_id").alias("rep")))
        of = some.select("doc_id", *signature).join(named, signature).select("doc_id", "sig_a", "rep")
        copies = s.cut(of.where("doc_id != rep"))
        repeated = of.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep != other").select("doc_id", F.col("rep").alias("least"))
        tied = of.join(side(repeated), "doc_id").select("rep", "least")
        distinct = some.join(side(copies.select("doc_id", "sig_a")), ["doc_id", "sig_a"], "left_anti").select("doc_id", "n", "low", "tokens")
        near = grouped(s, distinct, percent)
        clusters = s.cut(components(s, near))
        named_sets = clusters.select(F.col("id").alias("doc_id"), F.col("label").alias("cluster")).join(distinct.select("doc_id", "n"), "doc_id")
        chunks = named_sets.groupBy("cluster").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("chunks"))
        dealt = s.cut(named_sets.join(chunks, "cluster").select("doc_id", "n", "cluster", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), "members"))
        sizes = dealt.groupBy("cluster", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        places = s.cut(dealt.drop("n").distinct().join(sizes, ["cluster", "chunk"]))
        own = lambda name, other: F.coalesce(name, other).alias(name)
        placed = distinct.join(side(places), "doc_id", "left").select("doc_id", "n", own("cluster", "doc_id"), own("chunk", F.lit(0).cast("bigint")), own("members", F.lit(1).cast("bigint")), own("least", "n"), own("most", "n"), "tokens")
        s.free_shuffles()
        found = s.cut(candidates(s, placed, percent))
        s.free_shuffles()
        links = s.cut(opened(s, placed, found, percent))
        s.free_shuffles()
        labels = s.cut(components(s, near.union(links).union(tied)))
        rows = sets.select("doc_id", F.col("n").alias("n_shingles"), *signature).join(named, signature, "left")
        rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
        return keep(rows.withColumn("rep", rep).join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the document of each component that names it.

    Of rows that repeat ``doc_id`` and text one stays; rows with a null ``doc_id`` all stay.
    """
    gone = joined(docs, words, percent).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(side(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return left.join(side(repeated), "doc_id", "left_anti").select(*docs.columns).union(once)
