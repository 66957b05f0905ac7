"""Helpers of the corpus operators: scratch tables, fixed-size bitmaps, word hashes, id checksums."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymark.session import ensure_checkpoint_dir, ship_package

#: Bits of a bitmap that is sent to all tasks: 8 MB at most, whatever the size of the data; below that, bits for each value.
BITMAP_BITS, BITS_A_VALUE = 1 << 26, 64
#: Rows of a narrow table up to which it is sent to all tasks, about 40 MB at most; beyond, both sides of its join are shuffled.
SMALL_ROWS = 500_000
#: Entries of a worker's word cache before it starts afresh.
CACHED_WORDS = 1 << 18
#: What a worker holds from task to task of one operator; tasks of others let it go, since the worker goes on in their memory.
HELD: dict[str, dict] = {}
#: Rows and bytes of an Arrow batch that an operator hands back.
BATCH_ROWS = 8192
BATCH_BYTES = 16 << 20


#: Batches of long values are kept small: those read from Parquet by rows, those for Python by bytes as well.
BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; this package is sent to the executors along with it, and :data:`BATCHES` is set."""
    ship_package(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables in the shared checkpoint folder, for cutting lineage."""

    def __init__(self, spark: SparkSession):
        folder = ensure_checkpoint_dir(spark)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/scratch-{uuid.uuid4()}"

    def write(self, df: DataFrame) -> str:
        path = f"{self.root}/{uuid.uuid4()}"
        df.write.parquet(path)
        return path

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back: it survives lost executors and is not computed again."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df))

    def free_shuffles(self) -> None:
        """Let the shuffle files of finished steps go, which otherwise stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Scratch tables that are deleted at the end; what is returned must be cut in another scratch."""
    held = Scratch(spark)
    try:
        yield held
    finally:
        held.drop()


def keep(df: DataFrame) -> DataFrame:
    """A result cut into a table of its own, so that the scratch tables below it can go."""
    return Scratch(df.sparkSession).cut(df)


def bitmap(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """The values of a long column, modulo ``bits`` (a power of two), as a bitmap on the driver.

    Without ``bits`` the size follows the number of rows up to :data:`BITMAP_BITS`.
    Values are combined on the executors: at most ``bits / 64`` rows arrive, whatever ``df`` holds.
    A set bit means that a value may be there, a clear one that it is not.
    """
    bits = bits or min(BITMAP_BITS, 1 << max(16, (BITS_A_VALUE * df.count()).bit_length()))
    place = F.pmod(F.col(column), F.lit(bits))
    rows = (
        df.where(F.col(column).isNotNull())
        .select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int({bits - 1}L & pmod({column}, {bits}L) & 63))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.uint64, copy=False) & np.uint64(len(words) * 64 - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def may_hold(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose long ``column`` may be in the bitmap: a semi-join without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def keep_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            values = batch.column(column).fill_null(-1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bitmap(shared.value, values)))

    return df.mapInArrow(keep_rows, df.schema)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; None has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; starts afresh when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


@cache
def _multiplier(place: int) -> np.uint64:
    """An odd number for a place in a shingle; those of different places have no relation."""
    return mixed(np.array([place + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


def masked_shingles(words: np.ndarray, size: int, masks: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """A row for each mask: :func:`shingles` at its offsets. A word is multiplied once for each offset, not for each mask."""
    count = max(0, len(words) - size + 1)
    terms = [words[offset : offset + count] * _multiplier(offset) for offset in range(size)]
    total = np.full((len(masks), count), np.uint64(size))
    for row, mask in zip(total, masks, strict=True):
        for offset in mask:
            row += terms[offset]
    return mixed(total)


def shingles(words: np.ndarray, size: int, offsets: Iterable[int] | None = None) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or of the words at ``offsets`` of each run."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, np.uint64(size))
    for offset in range(size) if offsets is None else offsets:
        total += words[offset : offset + count] * _multiplier(offset)
    return mixed(total)


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def release(own: str | None = None) -> None:
    """Give back what earlier tasks of this worker have freed or left in :data:`HELD`, but for ``own``: their caches fragment its memory."""
    for name, held in HELD.items():
        if name != own:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches_of(schema: pa.Schema, rows: Iterable[tuple], size: Callable[[tuple], int] = lambda row: 64, own: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded rows and bytes; ``own`` names what the rows need of :data:`HELD`."""
    release(own)
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if len(held) >= BATCH_ROWS or held_bytes >= BATCH_BYTES:
            yield _batch(schema, held)
            held, held_bytes = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The named columns of Arrow batches row by row, as Python values."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in columns), strict=True)
