"""Phrases that stand together, and the transducers that count them, against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from steadymark.llm import collocations
from steadymark.llm.collocations import Transducer, summed, united


def brute(rows, least, top, percent=80):
    """Rows of ``(text, lang)`` to the phrases of each language."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for n in range(2, len(p)):
                gone.update(q for i in range(len(p) - n + 1) if 100 * a >= percent * f[q := p[i : i + n]])
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, b" ".join(p), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(df, **settings):
    return sorted(map(tuple, collocations.collocations(df, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def prose(rng, count):
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words += rng.choice([["New", "York", "City", "hall"], ["of", "the"], ["strong", "tea"], [f"w{rng.randrange(40)}"], ["the", "été"], ["a."], ["b\n"], ["x,y"]])
        rows.append((" ".join(words), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("settings", [{"least": 2, "top": 2000}, {"least": 5, "top": 7, "percent": 50}])
def test_phrases(spark, settings, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE", 50)  # many prefix ranges
    rows = prose(random.Random(1), 300) + [("", "en"), (None, "de"), (None, None), ("A\tb  A\vb", "und")] * 3 + [("same " * 4000, "long"), ("q. " * 50, "en")]
    df = spark.createDataFrame([(t, l, 1, "k") for t, l in rows], "text string, lang string, w1 int, cell string").repartition(5)
    assert found(df, **settings) == brute(rows, **{"percent": 80} | settings)


def test_given_rows_and_no_rows(docs, no_docs, rows):
    given = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert found(docs, least=3) == brute(given, 3, 2000)
    assert collocations.collocations(no_docs).count() == 0
    assert collocations.collocations(docs, least=10**9).count() == 0


def test_one_task(spark):
    rows = prose(random.Random(7), 60)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert found(df, least=2) == brute(rows, 2, 2000)


def sorted_paths(rng, count, letters):
    paths = {tuple(rng.randrange(1, letters) for _ in range(3)) + (0,) for _ in range(count)}
    paths |= {p[:3] + (rng.randrange(1, letters),) for p in list(paths)[::2]}
    return np.array(sorted(paths), np.uint64)


@pytest.mark.parametrize("letters", [2, 4, 60])
def test_transducer_holds_its_paths(letters):
    rng = random.Random(letters)
    paths = sorted_paths(rng, 200, letters)
    weights = np.array([rng.choice([1, 1, 2, 1 << 40]) for _ in paths])
    made = Transducer.from_bytes(Transducer.of(paths, weights).to_bytes())
    got, own = summed(*made.paths())
    assert (got == paths).all() and (own == weights).all()
    asked = np.array([p[:3] for p in paths.tolist()] + [[letters, 1, 1], [1, letters, 1], [1, 1, letters]], np.uint64)
    known = {tuple(p): w for p, w in zip(paths.tolist(), weights.tolist())}
    assert made.weights_of(asked).tolist() == [known.get((*p, 0), 0) for p in asked.tolist()]


def test_equal_endings_are_one_state():
    paths = np.array(sorted((a, b, c) for a in range(1, 30) for b in (1, 2) for c in (5, 6, 7)), np.uint64)
    made = Transducer.of(paths, np.ones(len(paths), np.int64))
    assert [len(level.labels) for level in made.levels] == [29, 2, 3]


def test_union_sums_weights():
    rng = random.Random(5)
    parts, total = [], Counter()
    for _ in range(5):
        paths = sorted_paths(rng, 80, 5)
        weights = np.array([rng.randrange(1, 9) for _ in paths])
        total.update(dict(zip(map(tuple, paths.tolist()), weights.tolist())))
        parts.append(Transducer.of(paths, weights))
    paths, weights = united(parts)
    assert dict(zip(map(tuple, paths.tolist()), weights.tolist())) == dict(total)
