"""Near duplicates by tensored banding, and the words and hashes of whole batches, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from steadymark.llm import minhash_dedup
from steadymark.llm.common import ascii_words
from steadymark.llm.word_streams import CHUNK, words_of

from test_pairs import least_linked, shingle_set

TEXTS = ["", None, " a  B\tc ", "é　x\n\x0by", "w" * (2 * CHUNK + 5) + " end", "a b", "b a", "ab", " ", "x\x00y \x00"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_a_batch(kind):
    texts = (TEXTS + ["many words " * 4000])[1:]
    found = words_of(pa.array(["left out", *texts], kind).slice(1))
    words = [ascii_words(t) for t in texts]
    assert [found.of(i) for i in range(len(found.starts))] == sum(words, [])
    assert np.diff(found.first).tolist() == [len(w) for w in words]
    pairs = set(zip(sum(words, []), found.hashes().tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_no_words():
    assert len(words_of(pa.array([], pa.string())).hashes()) == 0 and len(words_of(pa.array([None, ""], pa.string())).hashes()) == 0


def expected(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    label = least_linked(sets, percent)
    return sorted((i, len(own), label[i] if own else i, i == (label[i] if own else i)) for i, own in sets)


@pytest.mark.parametrize(("size", "percent", "blocks"), [(5, 85, {}), (5, 80, {"block_sets": 3}), (2, 85, {"block_tokens": 300})])
def test_components(docs, rows, size, percent, blocks):
    got = minhash_dedup.deduplicated(docs, size, percent, **blocks).where("doc_id is not null")
    assert sorted(map(tuple, got.collect())) == expected(rows, size, percent)


def test_null_ids_and_no_rows(docs, no_docs):
    assert {(r.component_id, r.kept) for r in minhash_dedup.deduplicated(docs).where("doc_id is null").collect()} == {(None, True)}
    assert minhash_dedup.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("block_sets", [4096, 16])
def test_a_group_of_edited_copies(spark, block_sets):
    """Copies of one text with few or many edits: some linked directly, some over others, some not at all."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(base) if rng.random() < 0.1 else f"{base[j]}" for j in range(150))) for i in range(20)]
    for i in range(20, 160):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    got = minhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 85, block_sets=block_sets)
    assert sorted(map(tuple, got.collect())) == expected(rows, 5, 85)


def test_half_keys_bound_the_missed_pairs():
    for percent in (80, 85, 90):
        count, same = minhash_dedup.half_keys(percent), (percent / 100) ** minhash_dedup.HALF
        assert 2 * (1 - same) ** count - (1 - same) ** (2 * count) <= minhash_dedup.MISSED
    rng = np.random.default_rng(1)
    sketch, hits, trials = minhash_dedup.Sketch(85), 0, 300
    for _ in range(trials):  # minhashes agree as often as the sets are similar
        tokens = rng.integers(0, 2**64, 185, dtype=np.uint64)
        a, b = sketch.of(tokens[:170]), sketch.of(tokens[15:])
        hits += (a == b).sum()
    share = hits / trials / (2 * sketch.count)
    assert abs(share - (155 / 185) ** minhash_dedup.HALF) < 0.03
