"""Benchmark decontamination by spaced seeds.

Fixed masks read some words of a run and ignore the others, so a substituted word leaves most seeds intact.
Seeds of the test items are joined with those of the documents; around each hit the words of both sides are
compared on the diagonal, and an overlap with enough equal words is reported.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import BITMAP_BITS, CACHED_WORDS, SMALL_ROWS, WordHashes, as_long, ascii_words, batches_of, bitmap, in_bitmap, keep, masked_shingles, scratch, shingles
from steadymark.llm.token_files import ddl

SPAN = 8
#: Places of a run of :data:`SPAN` words that each mask reads; fixed values.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 5, 7), (0, 2, 3, 5, 6, 7), (0, 1, 2, 3, 5, 7))
#: Most words of an overlap that is judged, and the share of them that must be equal.
OVERLAP, SHARE = 25, 0.8
PUNCTUATION = b".,;:!?\"'()[]{}<>*_-"

_SEEDS = pa.schema([("item_id", pa.int64()), ("item_key", pa.int64()), ("item_pos", pa.int64()), ("seed", pa.int64())])
_ITEMS = pa.schema([("item_id", pa.int64()), ("item_key", pa.int64()), ("item_words", pa.binary())])
_REGIONS = pa.schema([
    ("doc_id", pa.int64()), ("region", pa.int64()), ("first", pa.int64()), ("words", pa.binary()),
    ("places", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())),
])
_OVERLAPS = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("overlap", pa.int64()), ("equal", pa.int64()),
])


class BareWordHashes(WordHashes):
    """Hashes of words without punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.strip(PUNCTUATION))
        return value


def seeds_of(words: np.ndarray) -> np.ndarray:
    """One row of seeds for each mask. A text shorter than the span has one seed, of all its words."""
    if len(words) < SPAN:
        return shingles(words, len(words))[None, :] if len(words) else np.empty((1, 0), np.uint64)
    return masked_shingles(words, SPAN, MASKS) + np.arange(len(MASKS), dtype=np.uint64)[:, None]


def _key(words: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes()))))


def test_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = BareWordHashes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = hashes.of(ascii_words(text))
                    key = _key(words)
                    for row in seeds_of(words):
                        yield from ((item_id, key, place, seed) for place, seed in enumerate(as_long(row).tolist()))

        yield from batches_of(_SEEDS, rows())

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = BareWordHashes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = hashes.of(ascii_words(text))
                    if len(found):
                        yield item_id, _key(found), found.tobytes()

        yield from batches_of(_ITEMS, rows(), lambda r: len(r[-1]))

    named = items.select("item_id", "text")
    return named.mapInArrow(seeds, ddl(_SEEDS)), named.mapInArrow(words, ddl(_ITEMS))


def regions(docs: DataFrame, test_bits: np.ndarray) -> DataFrame:
    """Stretches of documents around seeds that the test side may hold, with the words in and beside them."""
    shared = docs.sparkSession.sparkContext.broadcast(test_bits)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = BareWordHashes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = hashes.of(ascii_words(text))
                    seeds = seeds_of(words)
                    hit = in_bitmap(shared.value, seeds.reshape(-1)).reshape(seeds.shape)
                    at = np.flatnonzero(hit.any(axis=0))
                    for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * OVERLAP) + 1) if len(at) else ():
                        first, stop = max(0, int(group[0]) - OVERLAP), min(len(words), int(group[-1]) + SPAN + OVERLAP)
                        masks, places = np.nonzero(hit[:, group])
                        places = group[places]
                        yield (
                            doc_id, int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(f"{doc_id} {first}".encode() + words[first:stop].tobytes())))),
                            first, words[first:stop].tobytes(), places.tolist(), as_long(seeds[masks, places]).tolist(),
                        )

        yield from batches_of(_REGIONS, rows(), lambda r: 64 + len(r[3]) + 16 * len(r[4]))

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(find, ddl(_REGIONS))


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> tuple[int, int, int] | None:
    """Start in the document, words and equal words of the best overlap of ``least`` words at this shift, if it is good enough.

    The overlap is then widened to all of the diagonal whose share of equal words stays as high.
    """
    low, high = max(0, shift), min(len(doc), shift + len(item))
    if high - low < least:
        return None
    equal = (doc[low:high] == item[low - shift : high - shift]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(equal)])
    counts = sums[least:] - sums[:-least]
    best = int(counts.argmax())
    if counts[best] < SHARE * least:
        return None
    start, stop = best, best + least
    while stop < len(equal) and sums[stop + 1] - sums[start] >= SHARE * (stop + 1 - start):
        stop += 1
    while start > 0 and sums[stop] - sums[start - 1] >= SHARE * (stop - start + 1):
        start -= 1
    return low + start, stop - start, int(sums[stop] - sums[start])


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, overlap, equal``: the best overlap of each document and test item.

    Places and lengths count words (A-Z lower-cased, without punctuation around them). An overlap has 25
    words, or all of a shorter item, of which 80 % are equal at one alignment; it is reported as far as that
    share holds. An item of fewer than 8 words only matches a document of exactly these words; an item or
    document without words matches nothing, nor does a null id. Repeated rows give one result. Empty tables
    give no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as s:
        seeds, words = (s.cut(t) for t in test_tables(items.where(F.col("item_id").isNotNull())))
        seeds = seeds.distinct()
        found = s.cut(regions(docs, bitmap(seeds, "seed", BITMAP_BITS)).dropDuplicates(["doc_id", "region"]))
        small = seeds.count() <= SMALL_ROWS
        side = F.broadcast if small else (lambda df: df)
        hits = found.select("region", F.explode(F.arrays_zip("places", "seeds")).alias("hit")).select("region", F.col("hit.places").alias("place"), F.col("hit.seeds").alias("seed"))
        lines = hits.join(side(seeds), "seed").select("region", "item_id", "item_key", (F.col("place") - F.col("item_pos")).alias("shift")).distinct()
        pairs = lines.join(side(words.distinct()), ["item_id", "item_key"]).join(found.select("doc_id", "region", "first", "words"), "region")

        def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for doc_id, item_id, first, words, item_words, shift in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        doc, item = np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64)
                        if len(item) < SPAN:
                            if first == 0 and np.array_equal(doc, item):
                                yield doc_id, item_id, 0, 0, len(item), len(item)
                        elif best := best_overlap(doc, item, shift - first, min(OVERLAP, len(item))):
                            yield doc_id, item_id, first + best[0], first + best[0] - shift, best[1], best[2]

            yield from batches_of(_OVERLAPS, rows())

        verified = pairs.select("doc_id", "item_id", "first", "words", "item_words", "shift").mapInArrow(verify, ddl(_OVERLAPS))
        best = F.max_by(F.struct("doc_start", "item_start", "overlap", "equal"), F.struct("equal", -F.col("overlap"), -F.col("doc_start"), -F.col("item_start")))
        return keep(verified.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` without an overlap with any test item; rows with a null ``doc_id`` stay."""
    return docs.join(overlaps(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
