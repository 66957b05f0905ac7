"""Periodic runs against a comparison of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from steadymark.llm import periodic_runs
from steadymark.llm.periodic_runs import Least, SuffixTree, runs_of


def brute_runs(words, periods=4, least=6):
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end > start:
                found.setdefault((start, end + p), p)  # the smallest period of a stretch comes first
            start = end + 1
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(least, periods * p))


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_short_strings(letters):
    rng = random.Random(letters)
    for _ in range(400):
        values = np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 30))], np.uint64)
        assert list(map(tuple, runs_of(values, 2, 2).tolist())) == brute_runs(values.tolist(), 2, 2)


def test_suffixes_are_in_order():
    rng = random.Random(8)
    for _ in range(100):
        values = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))]
        whole = [*values, 0]
        suffixes, depths = SuffixTree(values).tour()
        assert suffixes.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        for a, b, depth in zip(suffixes, suffixes[1:], depths[1:]):
            assert whole[a : a + depth] == whole[b : b + depth] and whole[a + depth] != whole[b + depth]
        assert SuffixTree(values).tour(falling=True)[0].tolist() == sorted(range(len(whole)), key=lambda i: [-x if x else -9 for x in whole[i:]])


def test_least_of_a_stretch():
    rng = np.random.default_rng(2)
    for size in (1, 5, 16, 17, 100, 700):
        values = rng.integers(0, 1000, size)
        low = rng.integers(0, size, 200)
        high = np.minimum(low + rng.integers(0, size, 200), size - 1)
        assert Least(values).of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


def repeating(rng):
    """Texts of which many parts come again and again, with and without words between them."""
    words = []
    for _ in range(rng.randrange(1, 9)):
        words += [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 12))]
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        words += (unit * rng.randrange(1, 8))[: rng.randrange(1, 40)]
    return " ".join(words)


def test_digest(spark, docs, rows):
    rng = random.Random(4)
    texts = [(1000 + i, repeating(rng)) for i in range(500)]
    texts.append((2000, " ".join(repeating(rng) for _ in range(150))))
    texts.append((2001, "A a " * 2500 + "b"))
    made = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    short = [(i, t) for i, t in rows if len(t or "") < 20000]
    given = docs.where("text is null or length(text) < 20000").select("doc_id", "text").union(made)
    got = sorted(map(tuple, periodic_runs.digest(given).collect()), key=repr)
    assert got == sorted((brute_digest(i, t) for i, t in short + texts), key=repr)


def test_long_texts_and_no_rows(spark, no_docs):
    rng = random.Random(6)
    words = " ".join(f"w{rng.randrange(3000)}" for _ in range(200_000))
    rows = [(1, words + " x y" * 20_000), (2, "same " * 60_000)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: (r.runs, r.text) for r in found.collect()}
    assert [tuple(r) for r in got[1][0]][-1] == (200_000, 40_000, 2) and got[1][1].endswith(" x y")
    assert [tuple(r) for r in got[2][0]] == [(0, 60_000, 1)] and got[2][1] == "same"
    assert periodic_runs.digest(no_docs).count() == 0


def test_planted_texts_change_one_of_ten(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(300)]
    got = periodic_runs.planted(spark.createDataFrame(rows, "doc_id bigint, text string"))
    changed = {r.doc_id for r in got.where(F.col("text") != rows[0][1]).collect()}
    assert changed and all(zlib.crc32(str(i).encode()) % 10 == 0 for i in changed)
