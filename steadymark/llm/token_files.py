"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with ``codebook`` (id, code length) and ``blocks``, both Parquet. A block holds whole
documents in ascending ``doc_id`` order, their numbers of ids, the coded ids, and the bit offset of every
256th id, so that a reader decodes all stretches of a block side by side by one table lookup an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadymark.llm.common import Scratch, batches_of, scratch
from steadymark.llm.tokens import BYTE_BPE, END_ID, ENCODERS, encoder

#: Longest code in bits; the decoding table has 2 to this power entries.
MAX_BITS = 16
#: Ids after which a block ends at the next document, and ids between two bit offsets.
BLOCK_IDS, STRETCH = 1 << 17, 256

_TOKENIZED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_BLOCKS = pa.schema([
    ("part", pa.int32()), ("row", pa.int64()), ("local_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
_DECODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{field.name} {kinds[field.type]}" for field in schema)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of at most ``limit`` bits with the fewest bits in all (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, levels = leaves, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        together = np.concatenate([leaves, pairs])
        ranked = np.argsort(together, kind="stable")
        merged = together[ranked]
        levels.append(ranked < len(leaves))
    take = 2 * len(leaves) - 2
    found = np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        found[:chosen] += 1
        take = 2 * (take - chosen)
    found[:take] += 1
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that count upwards by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    code, last = 0, 0
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order].astype(int)
    for size in np.unique(sizes):
        code <<= size - last
        members = order[sizes == size]
        codes[members] = code + np.arange(len(members))
        code, last = code + len(members), size
    return codes


def pack_bits(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after another, and the bit at which each begins."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    byte, value = begins >> 3, codes.astype(np.uint32) << (24 - sizes - (begins & 7)).astype(np.uint32)
    length = (total + 7) // 8 + 2
    data = np.zeros(length, np.uint8)
    for place in range(3):  # codes share bytes but no bits, so sums are unions
        part = ((value >> np.uint32(16 - 8 * place)) & np.uint32(255)).astype(np.float64)
        data[place:] += np.bincount(byte, part, minlength=length)[: length - place].astype(np.uint8)
    return data.tobytes(), begins


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next :data:`MAX_BITS` bits."""
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    if len(order):
        assert codes[order[0]] == 0 and filled <= 1 << MAX_BITS
    ids[:filled], sizes[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def unpack_bits(payload: bytes, offsets: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``count`` ids of a block; its stretches advance together."""
    if not count:
        return np.empty(0, np.uint32)
    ids, sizes = table
    data = np.frombuffer(payload + b"\0" * (STRETCH * MAX_BITS // 8 + 8), np.uint8).astype(np.uint32)
    window = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    at = offsets.astype(np.int64)
    out = np.empty((STRETCH, len(at)), np.uint32)
    last = len(window) - 1
    for step in range(min(STRETCH, count)):
        bits = (window[np.minimum(at >> 3, last)] >> (24 - MAX_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
        out[step] = ids[bits]
        at += sizes[bits]
    return out.T.reshape(-1)[:count]


def tokenized(docs: DataFrame, vocabulary: str, partitions: int) -> DataFrame:
    """Documents in ``doc_id`` order with their ids and places; a partition is a range of ``doc_id``."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([END_ID], own.dtype)

        def rows() -> Iterator[tuple]:
            row = start = 0
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for doc_id, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), own.encode(texts), strict=True):
                    yield doc_id, part, row, start, len(ids) + 1, np.concatenate([ids, end]).tobytes()
                    row, start = row + 1, start + len(ids) + 1

        yield from batches_of(_TOKENIZED, rows(), lambda r: len(r[-1]), ENCODERS)

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(encode, ddl(_TOKENIZED))


def global_counts(ids: DataFrame, width: str, vocabulary_size: int) -> np.ndarray:
    """Occurrences of every id over all rows: counted in each task, then summed."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                some = np.bincount(np.frombuffer(data.as_py(), width))
                found[: len(some)] += some
        used = np.flatnonzero(found)
        yield pa.record_batch([pa.array(used), pa.array(found[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary_size, np.int64)  # at most one row for each id of the vocabulary
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_files(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE, partitions: int | None = None) -> None:
    """Write the ids of all texts of ``docs``, each with the end id, as a file set at ``path``.

    A null or empty text has only the end id. Null ``doc_id`` come first, repeated ones are documents of
    their own, in the order of a hash of their texts. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    size = encoder(vocabulary).plain.get_vocab_size()
    width = encoder(vocabulary).dtype.str
    with scratch(spark) as s:
        ids = s.cut(tokenized(docs, vocabulary, partitions))
        lengths = code_lengths(global_counts(ids, width, max(size, END_ID + 1)))
        codes = canonical_codes(lengths)
        used = np.flatnonzero(lengths)
        book = spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used], pa.int32())}))
        book.coalesce(1).write.parquet(f"{path}/codebook")
        shared = spark.sparkContext.broadcast((codes, lengths))

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, lengths = shared.value

            def block(rows: list[tuple]) -> tuple:
                ids = np.concatenate([np.frombuffer(r[5], width) for r in rows])
                payload, begins = pack_bits(codes[ids], lengths[ids].astype(np.int64))
                return rows[0][1], rows[0][2], rows[0][3], [r[0] for r in rows], [r[4] for r in rows], begins[::STRETCH].tolist(), payload

            def blocks() -> Iterator[tuple]:
                held: list[tuple] = []
                count = 0
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if held and (held[-1][1] != row[1] or held[-1][2] + 1 != row[2]):  # a task may read several ranges
                            yield block(held)
                            held, count = [], 0
                        held.append(row)
                        count += row[4]
                        if count >= BLOCK_IDS:
                            yield block(held)
                            held, count = [], 0
                if held:
                    yield block(held)

            yield from batches_of(_BLOCKS, blocks(), lambda r: len(r[-1]))

        ids.mapInArrow(encode, ddl(_BLOCKS)).write.option("compression", "none").parquet(f"{path}/blocks")


def decoded(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a file set: ``doc_id``, ``part``, ``local_start``, ``n_tokens`` and ``ids`` (or ``ids_crc32``)."""
    rows = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(int(rows["id"].to_numpy().max(initial=-1)) + 1, np.uint8)
    lengths[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(decoding_table(lengths))
    schema = _DIGEST if digest else _DECODED

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part, _, start, doc_ids, counts, offsets, payload = (c[i].as_py() for c in batch.columns)
                    ids = unpack_bits(payload, np.array(offsets), sum(counts), shared.value).astype("<u4")
                    at = 0
                    for doc_id, n in zip(doc_ids, counts, strict=True):
                        data = ids[at : at + n].tobytes()
                        yield doc_id, part, start + at, n, zlib.crc32(data) if digest else data
                        at += n

        yield from batches_of(schema, rows(), lambda r: 64 if digest else len(r[-1]))

    return spark.read.schema(ddl(_BLOCKS)).parquet(f"{path}/blocks").mapInArrow(decode, ddl(schema))


def read_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """As :func:`decoded`, with ``start``, the ids of all documents before, in place of the local columns."""
    docs = decoded(spark, path, digest)
    totals = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the writer
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    value = "ids_crc32" if digest else "ids"
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", value)


def round_trip(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as a file set in the shared folder and digest what the files hold."""
    s = Scratch(docs.sparkSession)
    path = f"{s.root}/files"
    write_files(docs, path)
    return read_files(docs.sparkSession, path, digest=True)
