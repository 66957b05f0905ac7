"""Personal data: patterns, and terms that reveal what the patterns found.

The corpus tells how strongly a word beside a protected value (a mail address, say) gives it away: the
pointwise mutual information of word and value, as a share of the information in the value itself. At 1 the
word stands for the value; words above a threshold are removed, those somewhat below are generalised.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymark.llm.common import BITMAP_BITS, SMALL_ROWS, Scratch, as_long, batches_of, bitmap, in_bitmap, keep, scratch
from steadymark.llm.token_files import ddl

#: Kinds in the order that breaks ties; the method adds the last two.
KINDS = ("email", "ip", "card", "phone", "term", "general")
BASE = KINDS[:4]
#: Words to each side of a protected value that count as beside it.
BESIDE = 8
#: Share of a value's information above which a word is removed, and above which it is generalised.
REMOVE, GENERALISE = 0.9, 0.75
#: Different surroundings in which a word must stand beside a value: copies of one text prove nothing.
SUPPORT = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the first digit of a run only: where it fails there, it fails at the others.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_DIGIT = re.compile("[^0-9]+")

_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("kinds", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
    ("entity", pa.list_(pa.int64())), ("beside", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())),
    ("term", pa.list_(pa.int64())), ("text_key", pa.int64()), ("n_words", pa.int64()),
])

_HOLDERS = pa.schema([(name, pa.int64()) for name in ("doc_id", "text_key")] + [(name, pa.list_(pa.int64())) for name in ("entities", "terms", "starts", "ends")])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: what precedes it back to the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order; a match that fails its test is dropped."""
    found = [(start, 0, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _hash(value: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")))))


def text_key(text: str) -> int:
    """Tells rows with the same ``doc_id`` apart."""
    return _hash(text)


def _beside(text: str, start: int, end: int) -> list[re.Match]:
    """Up to :data:`BESIDE` words on each side, within a bounded stretch of the text."""
    reach = BESIDE * 32
    before = list(_WORD.finditer(text, max(0, start - reach), start))
    if before and before[0].start() == start - reach:
        before = before[1:]  # may be the end of a longer word
    after = list(_WORD.finditer(text, end, min(len(text), end + reach)))
    if after and after[-1].end() == end + reach < len(text):
        after = after[:-1]
    return before[-BESIDE:] + after[:BESIDE]


def _overlaps(opens: list[int], closes: list[int], start: int, end: int) -> bool:
    """Whether a stretch meets a span: ``opens`` in order, ``closes`` the farthest end of the spans up to each."""
    before = bisect_left(opens, end)
    return before > 0 and closes[before - 1] > start


def find(docs: DataFrame) -> DataFrame:
    """Base spans of every document, and the words beside each: one row a document, terms and values as hashes."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = text or ""
                    spans = base_spans(text)
                    entities, surroundings, held, terms = [], [], [], []
                    opens, closes = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
                    for start, kind, end in spans:
                        words = [m for m in _beside(text, start, end) if not _overlaps(opens, closes, m.start(), m.end())]
                        held.append(len(words))
                        entities.append(_hash(f"{KINDS[kind]}:{text[start:end].lower()}"))
                        surroundings.append(_hash(" ".join(m[0].lower() for m in words)))
                        terms += [_hash(m[0].lower()) for m in words]
                    yield (doc_id, [k for _, k, _ in spans], [s for s, _, _ in spans], [e for _, _, e in spans],
                           entities, surroundings, held, terms, text_key(text), text.count(" ") + 1)

        yield from batches_of(_FOUND, rows(), lambda r: 100 + 32 * len(r[1]) + 8 * len(r[7]))

    return docs.select("doc_id", "text").mapInArrow(search, ddl(_FOUND))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``n``: how often each word that may be in ``terms`` occurs in all texts, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms, "term", BITMAP_BITS))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        known: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = [w for w in _WORD.findall((text or "").lower())]
                new = [w for w in set(words) if w not in known]
                if len(known) + len(new) > 1 << 20:
                    known.clear()
                    new = list(set(words))
                if new:
                    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))
                    wanted = in_bitmap(shared.value, hashes)
                    known.update(zip(new, np.where(wanted, as_long(hashes), 0).tolist(), strict=True))
                for word in words:
                    if key := known[word]:
                        totals[key] = totals.get(key, 0) + 1
        yield pa.record_batch([pa.array(list(totals.keys()), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def each_span(found: DataFrame) -> DataFrame:
    """``value``, ``around``, ``terms``: one row a span, with the words beside it and no others."""
    spans = pa.schema([("value", pa.int64()), ("around", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for values, around, held, terms in zip(*(batch.column(c).to_pylist() for c in ("entity", "beside", "held", "term")), strict=True):
                    at = 0
                    for value, beside, n in zip(values, around, held, strict=True):
                        yield value, beside, terms[at : at + n]
                        at += n

        yield from batches_of(spans, rows(), lambda r: 32 + 8 * len(r[2]))

    return found.select("entity", "beside", "held", "term").mapInArrow(spread, ddl(spans))


def disclosing(docs: DataFrame, found: DataFrame, s: Scratch) -> DataFrame:
    """``entity``, ``term``, ``share``: words that reveal a value, and how much of its information."""
    beside = each_span(found)
    values = beside.groupBy("value", "around").count().groupBy("value").agg(F.sum("count").alias("n_value"), F.count("*").alias("arounds")).where(F.col("arounds") >= SUPPORT)
    pairs = (
        beside.select("value", "around", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("value", "term", "around").count()
        .groupBy("value", "term").agg(F.sum("count").alias("n_both"), F.count("*").alias("arounds"))
        .where(F.col("arounds") >= SUPPORT).drop("arounds")
    )
    pairs = s.cut(pairs.join(values.select("value", "n_value"), "value"))
    counted = pairs.join(occurrences(docs, pairs.select("term").distinct()), "term")
    total = found.agg(F.sum("n_words").alias("total"))
    share = F.log(F.col("n_both") * F.col("total") / (F.col("n_value") * F.col("n"))) / F.log(F.col("total") / F.col("n_value"))
    return counted.join(F.broadcast(total)).where(F.col("total") > F.col("n_value")).select(F.col("value").alias("entity"), "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def words_of_holders(docs: DataFrame, reveals: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``entities``, ``terms``, ``starts``, ``ends`` of the documents that may hold a value of
    ``reveals``: those values, and every word of the text outside base spans that may be one of its terms."""
    send = docs.sparkSession.sparkContext.broadcast
    values, words = (send(bitmap(reveals, column)) for column in ("entity", "term"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(keys: list[int], wanted: np.ndarray) -> list[bool]:
            return in_bitmap(wanted, np.array(keys, np.int64)).tolist()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    spans = base_spans(text or "")
                    found = list({_hash(f"{KINDS[kind]}:{text[start:end].lower()}") for start, kind, end in spans})
                    held = [key for key, hit in zip(found, marked(found, values.value), strict=True) if hit]
                    if not held:
                        continue
                    opens, closes = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
                    places = [m.span() for m in _WORD.finditer(text)]
                    distinct = list({text[start:end].lower() for start, end in places})
                    keys = [_hash(word) for word in distinct]
                    terms = {word: key for word, key, hit in zip(distinct, keys, marked(keys, words.value), strict=True) if hit}
                    hits = [(terms[word], start, end) for start, end in places if (word := text[start:end].lower()) in terms and not _overlaps(opens, closes, start, end)]
                    if hits:
                        yield doc_id, text_key(text), held, *map(list, zip(*hits, strict=True))

        yield from batches_of(_HOLDERS, rows(), lambda r: 40 + 8 * len(r[2]) + 24 * len(r[3]))

    return docs.select("doc_id", "text").mapInArrow(search, ddl(_HOLDERS))


def added_spans(docs: DataFrame, found: DataFrame, s: Scratch) -> DataFrame:
    """``doc_id``, ``text_key``, ``added``: the words of each document that disclose a value in it, wherever they stand.

    A word discloses by what the corpus holds beside its value; in a text with that value it goes everywhere. Texts
    without the value keep it: there it tells nothing about a protected value of theirs.
    """
    reveals = s.cut(disclosing(docs, found, s))
    key = ["doc_id", "text_key"]
    holders = s.cut(words_of_holders(docs, reveals).dropDuplicates(key))  # equal rows are sanitised alike
    same = lambda left, right, *more: [left.doc_id.eqNullSafe(right.doc_id), *(left[c] == right[c] for c in ("text_key", *more))]
    kind = F.when(F.col("share") >= REMOVE, KINDS.index("term")).otherwise(KINDS.index("general")).cast("bigint")
    owned = holders.select(*key, F.explode("entities").alias("entity"))
    distinct = holders.select(*key, F.explode(F.array_distinct("terms")).alias("term")).join(reveals, "term")
    kinds = distinct.join(owned, same(distinct, owned, "entity"), "left_semi").groupBy(*key, "term").agg(F.min(kind).alias("kind"))
    words = holders.select(*key, F.inline(F.arrays_zip("terms", "starts", "ends"))).toDF(*key, "term", "start", "end")
    place = words.join(kinds, same(words, kinds, "term")).select(words.doc_id, words.text_key, "start", "kind", "end")
    return place.groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def spans_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (start, kind, end) of every row: base matches, and those with disclosing words."""
    with scratch(docs.sparkSession) as s:
        found = s.cut(find(docs))
        added = added_spans(docs, found, s)
        base = F.transform(F.arrays_zip("starts", "kinds", "ends"), lambda x: F.struct(x.starts.alias("start"), x.kinds.alias("kind"), x.ends.alias("end")))
        plain = found.select("doc_id", "text_key", base.alias("base"))
        same = plain.doc_id.eqNullSafe(added.doc_id) & (plain.text_key == added.text_key)
        none = F.array().cast(plain.schema["base"].dataType)
        return keep(plain.join(added, same, "left").select(plain.doc_id, "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts by kind, ``base_sha256``, ``spans`` and ``n_terms``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. A null or empty text has
    none. Rows with a repeated or null ``doc_id`` are judged one by one. An empty table gives no rows. Other
    columns are ignored.
    """
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind.cast("int")), x.start, x.end)), ",")
    counted = lambda *kinds: F.size(F.filter("spans", lambda x: x.kind.isin(*kinds))).cast("bigint")
    return spans_of(docs).select(
        "doc_id", *(counted(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), counted(4, 5).alias("n_terms"),
    )


def sanitise(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; words to generalise keep only their shape."""
    parts, done = [], 0
    for start, kind, end in sorted(spans):
        if end <= done:
            continue
        start = max(start, done)
        parts.append(text[done:start])
        if KINDS[kind] == "general":
            parts.append("[NUMBER]" if text[start:end].isdigit() else "[NAME]" if text[start].isupper() else "[WORD]")
        else:
            parts.append("" if KINDS[kind] == "term" else f"[{KINDS[kind].upper()}]")
        done = end
    return "".join([*parts, text[done:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of every text replaced and ``n_chars``, where there is one, counted anew.

    Rows with a null or repeated ``doc_id`` are told apart by their texts. A null text stays null.
    """
    with scratch(docs.sparkSession) as s:
        added = s.cut(added_spans(docs, s.cut(find(docs)), s))
        name, spans = (next(n for i in range(len(docs.columns) + 1) if (n := f"{stem}_{i}") not in docs.columns) for stem in ("of", "spans"))
        of_doc = keep(added.groupBy(F.col("doc_id").alias(name)).agg(F.collect_list(F.struct("text_key", "added")).alias(spans)))
    side = F.broadcast if of_doc.count() <= SMALL_ROWS else (lambda df: df)
    joined = docs.join(side(of_doc), F.col("doc_id").eqNullSafe(F.col(name)), "left").drop(name)
    place = docs.columns.index("text")

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if texts[i]:
                    own = text_key(texts[i]) if found else 0
                    more = [(x["start"], x["kind"], x["end"]) for f in found or () if f["text_key"] == own for x in f["added"]]
                    texts[i] = sanitise(texts[i], base_spans(texts[i]) + more)
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    cleaned = joined.mapInArrow(replace, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
