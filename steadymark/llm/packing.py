"""Packing by non-negative least squares on the histogram of lengths.

Lengths count units of 64 ids. A document is cut into full windows, a body of whole units and a tail of less
than a unit. Combinations of up to three bodies that fill a window are enumerated, their repeat counts solved
against the histogram and rounded down. What is left of the bodies, and the tails, is packed greedily one
after another and cut where a window ends. All places follow from ranks within a length, so no task sees
more than a bucket of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadymark.llm.common import batches_of, keep, scratch
from steadymark.llm.token_files import ddl
from steadymark.llm.tokens import END_ID, ENCODERS, WORD_BPE, encoder

WINDOW, UNIT = 4096, 64
UNITS = WINDOW // UNIT
#: Most bodies in an enumerated combination.
DEPTH = 3
#: Rows of a bucket in which ranks are counted by one task, on average.
BUCKET_ROWS = 50_000
FULL, BODY, TAIL = 0, 1, 2

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("detail", pa.binary()),
])
_PLACED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def crc_of_units(crcs: np.ndarray) -> int:
    """The crc32 of units one after another from the crc32 of each: appending is linear up to the crc of zeros."""
    zeros = bytes(4 * UNIT)
    of_zeros = zlib.crc32(zeros)
    total = 0
    for i, crc in enumerate(crcs.tolist()):
        total = crc if i == 0 else zlib.crc32(zeros, total) ^ crc ^ of_zeros
    return total


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Each document's full windows, body and tail; ``detail`` has the unit checksums of a body, the ids of a tail."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, END_ID).astype("<u4")
                    n, data = len(ids), ids.tobytes()
                    full, rest = n // WINDOW, n % WINDOW
                    for i in range(full):
                        yield doc_id, i * WINDOW, WINDOW, zlib.crc32(data[4 * WINDOW * i : 4 * WINDOW * (i + 1)]), n, FULL, UNITS, None
                    at, units = full * WINDOW, rest // UNIT
                    if units:
                        body = data[4 * at : 4 * (at + units * UNIT)]
                        crcs = np.array([zlib.crc32(body[i : i + 4 * UNIT]) for i in range(0, len(body), 4 * UNIT)], "<u4")
                        yield doc_id, at, units * UNIT, zlib.crc32(body), n, BODY, units, crcs.tobytes()
                    at += units * UNIT
                    if n > at:
                        yield doc_id, at, n - at, zlib.crc32(data[4 * at :]), n, TAIL, n - at, data[4 * at :]

        yield from batches_of(_PIECES, rows(), lambda r: 64 + len(r[-1] or b""), ENCODERS)

    return docs.select("doc_id", "text").mapInArrow(cut, ddl(_PIECES))


def combinations(total: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write ``total`` as 2 to ``depth`` smaller numbers in ascending order."""

    def ways(rest: int, least: int, parts: int) -> Iterator[tuple[int, ...]]:
        if parts == 1:
            if rest >= least:
                yield (rest,)
            return
        for first in range(least, rest // parts + 1):
            for more in ways(rest - first, first, parts - 1):
                yield (first, *more)

    return [c for parts in range(2, depth + 1) for c in ways(total, 1, parts)]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least squared a x - b, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if active.all() or gain.max() <= slack:
            break
        active[int(gain.argmax())] = True
        while True:
            tried = np.zeros_like(x)
            tried[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (tried[active] > 0).all():
                x = tried
                break
            worse = active & (tried <= 0)
            step = (x[worse] / np.maximum(x[worse] - tried[worse], 1e-300)).min()
            x = np.maximum(x + step * (tried - x), 0)
            active &= x > slack * 1e-3
            x[~active] = 0
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to fill a window by each; none uses a length more often than it occurs."""
    found = combinations()
    a = np.zeros((UNITS, len(found)))
    for j, combination in enumerate(found):
        for units in combination:
            a[units, j] += 1
    b = histogram[:UNITS].astype(float)
    counts = np.floor(nnls(a, b) + 1e-6).astype(np.int64)
    left = histogram[:UNITS].astype(np.int64)
    chosen = []
    for j in np.argsort(-counts, kind="stable"):
        uses = a[:, j].astype(np.int64)
        count = int(min(counts[j], (left[uses > 0] // uses[uses > 0]).min()))
        if count > 0:
            left -= count * uses
            chosen.append((found[j], count))
    return chosen


def ranked(parts: DataFrame, rows: int) -> DataFrame:
    """``rank`` of each piece among those of its kind and size, from 0: ranks in hash buckets plus an offset for each."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    key = ["kind", "size"]
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    own = Window.partitionBy(*key, "bucket").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*key, "bucket").count().select(*key, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets, [*key, "bucket"]).withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def place(parts: DataFrame) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; those that a window's end cuts come in parts."""
    spark = parts.sparkSession
    counts = {(r.kind, r.size): r["count"] for r in parts.groupBy("kind", "size").count().collect()}  # at most 2 * 64 rows
    histogram = np.array([counts.get((BODY, units), 0) for units in range(UNITS)])
    full = counts.get((FULL, UNITS), 0)
    slots, sequence, used = [(FULL, UNITS, 0, full, 0, 0)], full, np.zeros(UNITS, np.int64)
    for combination, count in repeats(histogram):
        offset = 0
        for units in combination:
            slots.append((BODY, units, int(used[units]), int(used[units]) + count, sequence - int(used[units]), offset * UNIT))
            used[units] += count
            offset += units
        sequence += count
    # The line of what is left: bodies by length, then tails by length; a place is a rank times a length.
    line, at = [], 0
    for kind, size, first, n, ids in [(BODY, u, int(used[u]), counts.get((BODY, u), 0), u * UNIT) for u in range(1, UNITS)] + [(TAIL, t, 0, counts.get((TAIL, t), 0), t) for t in range(1, UNIT)]:
        line.append((kind, size, first, at))
        at += (n - first) * ids
    slot = spark.createDataFrame(slots, "kind int, size int, low bigint, high bigint, shift bigint, offset bigint")
    lined = spark.createDataFrame(line, "kind int, size int, first bigint, base bigint")
    ordered = ranked(parts, sum(counts.values()))
    fits = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = ordered.alias("p").join(F.broadcast(slot).alias("s"), (F.col("p.kind") == F.col("s.kind")) & (F.col("p.size") == F.col("s.size")) & fits, "left")
    both = joined.select("p.*", (F.col("rank") + F.col("shift")).alias("sequence_id"), F.col("offset"))
    both = both.join(F.broadcast(lined), ["kind", "size"], "left")
    on_line = F.col("base") + (F.col("rank") - F.col("first")) * F.col("length")
    both = both.withColumns({
        "sequence_id": F.coalesce("sequence_id", F.lit(sequence) + F.floor(on_line / WINDOW)),
        "offset": F.coalesce("offset", F.pmod(on_line, F.lit(WINDOW))),
    })

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, start, length, crc, n, kind, detail, sequence_id, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    fits = WINDOW - offset
                    if length <= fits:
                        yield doc_id, start, length, crc, n, sequence_id, offset
                        continue
                    if kind == BODY:
                        units = np.frombuffer(detail, "<u4")
                        first, second = crc_of_units(units[: fits // UNIT]), crc_of_units(units[fits // UNIT :])
                    else:
                        first, second = zlib.crc32(detail[: 4 * fits]), zlib.crc32(detail[4 * fits :])
                    yield doc_id, start, fits, first, n, sequence_id, offset
                    yield doc_id, start + fits, length - fits, second, n, sequence_id + 1, 0

        yield from batches_of(_PLACED, rows())

    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "detail", "sequence_id", "offset").mapInArrow(split, ddl(_PLACED))


def pack(docs: DataFrame, vocabulary: str = WORD_BPE) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every window is full but the last. A null or empty text is one piece with the end id. Rows with a null or
    repeated ``doc_id`` are documents of their own; equal rows give equal pieces in different places. An empty
    table gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as s:
        return keep(place(s.cut(pieces(docs, vocabulary))))
