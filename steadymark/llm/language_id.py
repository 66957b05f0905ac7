"""Language ID by string kernels.

The kernel of two texts is the cosine of their sets of n-grams (presence, lengths 2 to 4 together, every n-gram of
either counted). Landmark texts give a Nyström map of the kernel, in which one ridge regression for each language is
fitted against the rest; the regressions tell the language and whether a text is in any. The landmarks bound what a
model holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steadymark.llm.common import batches_of, release
from steadymark.llm.token_files import ddl

#: Labelled texts to fit on, and landmarks among them, for each language at most.
FIT_TEXTS, LANDMARKS = 400, 32
#: N-grams are hashed to so many codes.
CODES = 1 << 22
RIDGE, SHARPNESS = 1e-2, 6.0
#: Share of a language's labelled texts, those least like it, that do not set its margin: wrong labels.
SPARE = 0.01
UNKNOWN = "und"
#: Texts of a matrix product.
ROWS = 256

_LETTER = regex.compile(r"\p{L}")
#: Bytes other than ASCII letters and those of longer characters become spaces.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of 2, 3 and 4 bytes of the lower-cased text, repeats included."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
    two = (data[:-1] << np.uint32(8)) | data[1:]
    three = (two[:-1] << np.uint32(8)) | data[2:]
    four = (three[:-1] * np.uint32(0x9E3779B1)) ^ (data[3:] * np.uint32(0x85EBCA77))
    spread = np.concatenate([two * np.uint32(0xC2B2AE3D), three * np.uint32(0x9E3779B1) + np.uint32(1), four * np.uint32(0x27D4EB2F) + np.uint32(2)])
    return spread >> np.uint32(32 - 22)


@dataclass(frozen=True)
class Landmarks:
    """The feature of each code (-1: in no landmark), which landmarks have a feature, and how many n-grams each has."""

    feature: np.ndarray
    present: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, codes: Sequence[np.ndarray]) -> Landmarks:
        """Those of texts given by the codes of their n-grams, each once."""
        known = np.unique(np.concatenate(codes))
        feature = np.full(CODES, -1, np.int32)
        feature[known] = np.arange(len(known))
        present = np.zeros((len(known), len(codes)), np.uint8)
        for i, own in enumerate(codes):
            present[feature[own], i] = 1
        return cls(feature, present, np.array([len(own) for own in codes]))

    def kernel(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        """N-grams that texts share with landmarks over the geometric mean of all that both have; 0 for a text without any."""
        shared = np.zeros((len(codes), len(self.sizes)))
        for row, own in zip(shared, codes, strict=True):
            at = self.feature[own]
            row[:] = self.present[at[at >= 0]].sum(axis=0, dtype=np.int32)
        return shared / (np.sqrt(np.maximum([len(own) for own in codes], 1))[:, None] * np.sqrt(np.maximum(self.sizes, 1)))


@dataclass(frozen=True)
class Model:
    """Languages, landmarks, the weights of their kernels, and the least output with which a text is in a language."""

    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray
    least: np.ndarray
    #: Features that two landmarks have at least.
    common: np.ndarray

    def outputs(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        """A row for each text with the output of each language's regression."""
        return self.landmarks.kernel(codes) @ self.weights[:-1] + self.weights[-1]

    def scores(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        """A row for each text with a score for each language; scores of a row add to 1."""
        found = self.outputs(codes)
        powers = np.exp(SHARPNESS * (found - found.max(axis=1, keepdims=True)))
        return powers / powers.sum(axis=1, keepdims=True)

    def accepted(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        """Whether each text is in the language that its best output names, and has an n-gram of two landmarks."""
        found = self.outputs(codes)
        best = found.argmax(axis=1)
        features = [self.landmarks.feature[own] for own in codes]
        shares = np.array([bool(self.common[at[at >= 0]].any()) for at in features], bool)
        return shares & (found[np.arange(len(codes)), best] >= self.least[best])


def ngram_set(text: str) -> np.ndarray:
    return np.unique(ngram_codes(text))


def margins(own: Sequence[np.ndarray], nothing: np.ndarray) -> np.ndarray:
    """The least output of each language: halfway from that of a text that shares no n-gram to the least of its labelled texts.

    Where labelled texts are no more like their language than such a text, the regression tells nothing and accepts all.
    """
    low = np.array([np.quantile(values, SPARE, method="lower") for values in own])
    return np.where(low > nothing + 1e-6, (low + nothing) / 2, -np.inf)


def train(texts: list[str], labels: list[str]) -> Model | None:
    """Fit on labelled texts in the given order, whose first of each language are landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rank = {name: 0 for name in languages}
    chosen = []
    for i, name in enumerate(labels):
        if rank[name] < LANDMARKS:
            chosen.append(i)
        rank[name] += 1
    codes = [ngram_set(t) for t in texts]
    landmarks = Landmarks.of([codes[i] for i in chosen])
    every = landmarks.kernel(codes)
    values, vectors = np.linalg.eigh(every[chosen])
    keep = values > 1e-8 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    mapped = np.column_stack([every @ nystrom, np.ones(len(texts))])
    wanted = np.array([[1.0 if name == own else -1.0 for name in languages] for own in labels])
    weight = np.array([1 / labels.count(own) for own in labels])[:, None] * len(labels) / len(languages)
    penalty = RIDGE * len(texts) * np.eye(mapped.shape[1]) / len(languages)
    penalty[-1, -1] = 0
    fitted = np.linalg.solve(mapped.T @ (weight * mapped) + penalty + 1e-9 * np.eye(len(penalty)), mapped.T @ (weight * wanted))
    outputs, of = mapped @ fitted, np.array(labels, dtype=object)
    least = margins([outputs[of == name, i] for i, name in enumerate(languages)], fitted[-1])
    common = landmarks.present.sum(axis=1, dtype=np.int32) > 1
    return Model(languages, landmarks, np.vstack([nystrom @ fitted[:-1], fitted[-1:]]).astype(np.float64), least, common if common.any() else ~common)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame) -> Model | None:
    """A model of the labelled rows outside the held-out fold.

    It is fitted on at most :data:`FIT_TEXTS` texts with letters of each language, those with the least hashes.
    """
    labelled = docs.select("text", "lang").where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = labelled.select("lang", F.xxhash64("text").alias("place")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    last = place.withColumn("first", first).where(F.col("first") <= FIT_TEXTS).groupBy("lang").agg(F.max("place").alias("last"))
    hashed = labelled.withColumn("place", F.xxhash64("text"))
    rows = hashed.join(F.broadcast(last), "lang").where(F.col("place") <= F.col("last")).dropDuplicates(["lang", "place"]).select("lang", "text", "place").toArrow()
    order = np.lexsort((rows["place"].to_numpy(), np.array(rows["lang"].to_pylist(), dtype=object).astype(str))) if rows.num_rows else []
    texts, labels = rows["text"].to_pylist(), rows["lang"].to_pylist()
    return train([texts[i] for i in order], [labels[i] for i in order])


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs``.

    Without a model, one is fitted on the labelled rows. A text that is null or without letters is ``und``
    with score 0, and so is every text if no row is labelled; other texts get the language with the highest
    score, between 0 and 1, ties to the first in order. A null ``doc_id`` is not held out and not learned
    from. Repeated rows are predicted one by one. An empty table gives no rows.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, held, texts = (c.to_pylist() for c in batch.columns)
                for at in range(0, len(ids), ROWS):
                    part = range(at, min(at + ROWS, len(ids)))
                    known = [i for i in part if model and has_letter(texts[i])]
                    scores = model.scores([ngram_set(texts[i]) for i in known]) if known else np.empty((0, 1))
                    best = dict(zip(known, zip(scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True), strict=True)) if known else {}
                    for i in part:
                        name, score = (model.languages[best[i][0]], best[i][1]) if i in best else (UNKNOWN, 0.0)
                        yield ids[i], held[i], name, score

        yield from batches_of(_PREDICTED, rows())

    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(label, ddl(_PREDICTED))


def kept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of ``docs`` that have one of the learned languages.

    Those that :func:`predict` calls ``und`` go, those that share no n-gram with two landmarks, and those whose best
    output is below the margin of its language: nearer to a text that shares nothing than to the labelled texts.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in batches:
            known = []
            texts = batch.column(place).to_pylist()
            for at in range(0, len(texts), ROWS):
                part = texts[at : at + ROWS]
                seen = model.accepted([ngram_set(t or "") for t in part]) if model else np.zeros(len(part), bool)
                known.extend(has_letter(t) and bool(x) for t, x in zip(part, seen, strict=True))
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)
