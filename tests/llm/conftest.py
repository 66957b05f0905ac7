import random

import pytest

#: Rows that every operator has to bear: nulls, empty and very long texts, repeated rows, odd characters.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, token int, cluster int, of_0 string, spans_0 string, count int"


def words(rng, n, stem="w", vocabulary=400):
    return [f"{stem}{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    texts = []
    for i in range(40):
        texts.append(" ".join(words(rng, rng.randrange(1, 120), "ab"[i % 2])))
    base = words(rng, 200, "near")
    for _ in range(12):  # near copies, some of them linked only through others
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    passage = words(rng, 70, "pass")
    texts += [" ".join(words(rng, 40, "c") + passage + words(rng, 30, "d")) for _ in range(5)]
    texts += [None, None, "", "   \n\t ", "one", "one", "two words", "Two  WORDS", "a b c", "!!! ???", "日本語 テキスト"]
    texts += [texts[0]] * 4 + [" ".join(words(rng, 9000, "long"))] + ["same " * 3000]
    texts += ["mail ann.b+c@x-y.example.org now, or 10.0.0.255 and 10.0.0.256, +1 (555) 010-9999, 4111 1111 1111 1111."]
    rows = [(i, t, ("en", "fr")[i % 2] if i % 7 else None, None, len(t or ""), "k", 1, 2, "o", "s", 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (4, "another text for an id that repeats", *rows[4][2:]), (None, texts[5], *rows[5][2:]), (None, None, *rows[5][2:]), (-8, texts[9], *rows[5][2:])]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in corpus()]
