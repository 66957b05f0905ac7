"""Jaccard join, repeated passages, decontamination, components: against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from steadymark.llm import decontaminate, jaccard_join, substring_dedup
from steadymark.llm.common import Scratch, bitmap, may_hold, shingles
from steadymark.llm.graph import components
from steadymark.llm.minhash_dedup import sets_of


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def least_linked(sets, percent):
    """Component names by comparing all pairs; rows of one id are one node."""
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations([x for x in sets if x[1]], 2):
        if i == j or 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i: root(i) for i in parent}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_join(docs, rows, size, percent):
    got = sorted(map(tuple, jaccard_join.joined(docs, size, percent).where("doc_id is not null").collect()))
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    label = least_linked(sets, percent)
    assert got == sorted((i, len(own), label[i] if own else i) for i, own in sets)


def test_jaccard_join_null_ids_and_no_rows(docs, no_docs):
    assert {r.component_id for r in jaccard_join.joined(docs).where("doc_id is null").collect()} == {None}
    assert jaccard_join.joined(no_docs).count() == 0


def test_jaccard_join_splits_hot_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 2)
    monkeypatch.setattr(jaccard_join, "PARTS", (2, 4, 8))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(jaccard_join, "SMALL_ROWS", 0)
    test_jaccard_join(docs, rows, 4, 85)


def test_jaccard_join_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    label = least_linked([(i, shingle_set(t, 4)) for i, t in enumerate(texts)], 85)
    got = jaccard_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_one_of_each(docs, rows):
    label = least_linked([(i, shingle_set(t, 5)) for i, t in rows if i is not None], 80)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    ids = {i for i, t in rows if i is not None and (label[i] == i)}
    assert {i for i in kept if i is not None} == ids
    assert kept.count(None) == 2 and kept.count(3) == 1 and kept.count(4) == 2


def test_shingles_of_permuted_words_differ():
    x, y = np.array([3, 9], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = np.array([[a, b, c, d] for a in (x, y) for b in (x, y) for c in (x, y) for d in (x, y)])
    assert len({int(shingles(r, 4)[0]) for r in runs}) == 16


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    label = {i: i for e in edges for i in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components(Scratch(spark), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: x for i, x in label.items() if i != 7}


def test_bitmap_never_misses(spark):
    df = spark.createDataFrame([(i,) for i in (-5, -1, 0, 63, 64, 2**62, None)], "x bigint")
    assert {r.x for r in may_hold(df, "x", bitmap(df, "x", 1 << 12)).collect()} >= {-5, -1, 0, 63, 64, 2**62}
    assert may_hold(df, "x", bitmap(df.limit(0), "x", 1 << 12)).count() == 0


def passages_by_brute_force(rows, least):
    """Documents that share a run of words with another text of an earlier document."""
    runs, found = {}, set()
    for i, text in sorted((i, t) for i, t in rows if i is not None and t):
        words = text.encode().lower().split()
        own = {tuple(words[j : j + least]) for j in range(len(words) - least + 1)}
        if any(runs.get(r, i) != i for r in own):
            found.add(i)
        for r in own:
            runs.setdefault(r, i)
    return found


def test_passages(docs, no_docs, rows):
    got = substring_dedup.passages(docs).collect()
    words = {}
    for i, t in rows:
        words.setdefault(i, []).append((t or "").encode().lower().split())
    assert passages_by_brute_force(rows, 50) <= {r.doc_id for r in got}
    for r in got:
        assert r.end - r.start >= 50 and r.equal >= 0.8 * (r.end - r.start)
        pairs = [sum(a == b for a, b in zip(x[r.start : r.end], y[r.other_start : r.other_end])) for x in words[r.doc_id] for y in words[r.other_id]]
        assert r.end - r.start != r.other_end - r.other_start or max(pairs) == r.equal
    assert substring_dedup.passages(no_docs).count() == 0


def test_passages_split_hot_seeds(docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEED", 1)
    monkeypatch.setattr(substring_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "PARTS", 3)
    test_passages(docs, no_docs, rows)


def test_chains_follow_order_and_pay_for_gaps():
    assert substring_dedup.chains([0, 6, 12, 13], [5, 11, 17, 2]) == [([0, 6, 12], [5, 11, 17])]
    assert substring_dedup.chains([0, 500], [0, 500]) == []  # the gap costs more than a match earns
    (xs, ys), *rest = substring_dedup.chains([0, 5, 5, 10, 16], [3, 1, 8, 13, 21])
    assert (xs, ys, rest) == ([0, 5, 10, 16], [3, 8, 13, 21], [])


def test_alignment_switches_diagonal():
    x = np.arange(40, dtype=np.uint32)
    y = np.concatenate([x[:18], np.array([99, 98], np.uint32), x[18:]])
    assert substring_dedup.align(x, y, [2, 30], [2, 32]) == (0, 40, 0, 42, 40)


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    changed = list(item)
    for i in (4, 11, 19, 27):
        changed[i] = "changed"
    far = [w if i % 3 else "other" for i, w in enumerate(item)]
    filler = lambda: [f"z{rng.randrange(10**6)}" for _ in range(50)]
    texts = [filler() + item + filler(), filler() + [w.upper() + "," for w in changed], filler() + far + filler(), filler(), "What is it ?".split(), filler() + "what is it ?".split(), item[5:], item[:12] + filler()]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(0, " ".join(texts[0])), (8, None), (9, ""), (None, " ".join(item))], "doc_id bigint, text string")
    items = spark.createDataFrame([(70, " ".join(item), 1), (71, "what is it ?", 1), (72, None, 1), (73, "", 1), (None, "x y", 1), (70, " ".join(item), 1)], "item_id bigint, text string, seed int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(table, items).collect()}
    assert set(got) == {(0, 70), (1, 70), (4, 71), (6, 70)}
    assert tuple(got[0, 70])[2:] == (50, 0, 30, 30)
    assert got[1, 70].equal == 26
    assert decontaminate.overlaps(table, items).count() == 4
    assert sorted((r.doc_id is None, r.doc_id) for r in decontaminate.decontaminated(table, items).collect()) == [(False, i) for i in (2, 3, 5, 7, 8, 9)] + [(True, None)]
    assert decontaminate.overlaps(no_docs, items).count() == 0 and decontaminate.overlaps(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, items).columns == docs.columns


def test_passages_of_one_pair_are_told_apart(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    short, long = [fresh(60) for _ in range(2)], [fresh(300) for _ in range(2)]
    texts = [fresh(20) + s[0] + fresh(gap) + s[1] + fresh(20) for s, gap in ((short, 40), (short, 140), (long, 200), (long, 700))]
    texts += [short[0] + fresh(10) + short[1]]  # its longest chain is accepted as a whole
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    spans = {i: sorted((r.start, r.end, r.equal) for r in got if r.doc_id == i) for i in (1, 3, 4)}
    assert spans[1] == [(20, 80, 60), (220, 280, 60)]
    assert spans[3] == [(20, 320, 300), (1020, 1320, 300)]
    assert spans[4] == [(0, 60, 60), (70, 130, 60)] or spans[4] == [(0, 130, 120)]
    assert len(got) == 4 + len(spans[4])


def test_segments_of_an_alignment():
    equal = np.array([1] * 60 + [0] * 40 + [1] * 60 + [0] * 30 + [1] * 20, bool)
    both = np.ones(len(equal), bool)
    assert substring_dedup.segments(both, both, equal) == [(0, 60), (100, 160)]
    assert substring_dedup.segments(both[:75], both[:75], equal[:75]) == [(0, 75)]


def by_value(words):
    sets = sets_of(pa.record_batch({"text": pa.array(words)}), 1)
    return [w for _, w in sorted((int(own[0]), w) for own, w in zip(sets, words, strict=True))]


def joined_words(spark, sets):
    rows = [(i, " ".join(sorted(own))) for i, own in enumerate(sets)]
    got = {r.doc_id: r.component_id for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 85).collect()}
    return got, least_linked(list(enumerate(map(frozenset, sets))), 85)


def test_jaccard_join_where_frequent_tokens_go_last(spark):
    x, *t = by_value([f"t{i}" for i in range(11)])
    rare = [w for w in by_value([f"u{i}" for i in range(400)]) if by_value([t[0], w])[0] == t[0]]
    got, label = joined_words(spark, [t, [x, *t], *([t[0], w] for w in rare[:80])])
    assert got == label and got[1] == 0


def test_jaccard_join_of_sets_with_many_frequent_tokens(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    sets = []
    for i in range(250):
        own = [f"r{i}_{j}" for j in range(rng.randrange(8, 25))] + rng.sample(shared, rng.randrange(10, 25))
        sets += [own, [*own, *(f"m{i}_{j}" for j in range(int(len(own) / 0.85) - len(own)))]]
    got, label = joined_words(spark, sets)
    assert got == label


def test_passages_every_copy_in_a_text(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    own = fresh(60)
    texts = [fresh(20) + own, fresh(30) + own + fresh(150) + own + fresh(10)]
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.equal) for r in got) == [(1, 30, 90, 60), (1, 240, 300, 60)]


def fragments(rng, passage, fresh):
    """Texts that have 40 words of a passage each, and together all its seeds."""
    return [fresh(15) + passage[at : at + 40] + fresh(15) for at in range(0, len(passage) - 25, 15)]


@pytest.mark.parametrize("hot", [False, True])
def test_passages_whose_seeds_are_first_and_last_elsewhere(spark, monkeypatch, hot):
    if hot:
        for name, value in (("HOT_SEED", 1), ("HOT_SAMPLE", 1), ("PARTS", 3)):
            monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(9)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    texts, wanted = [], set()
    for length in (50, 57, 90):
        passage = fresh(length)
        texts += fragments(rng, passage, fresh)
        early = len(texts)
        texts.append(fresh(30) + passage + fresh(20))
        texts += fragments(rng, passage, fresh)
        wanted.add((len(texts), 10, 10 + length, early, 30, 30 + length, length))
        texts.append(fresh(10) + passage + fresh(40))
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end, r.equal) for r in got} == wanted


@pytest.mark.parametrize("hot, crowd", [(False, 8192), (True, 8192), (False, 2)])
def test_changed_passages_whose_seeds_are_first_and_last_elsewhere(spark, monkeypatch, hot, crowd):
    if hot:
        for name, value in (("HOT_SEED", 1), ("HOT_SAMPLE", 1), ("PARTS", 3)):
            monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(substring_dedup, "CROWD", crowd, raising=False)
    rng = random.Random(10)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    texts, wanted = [], set()
    for _ in range(3):
        lines = [fresh(18) for _ in range(4)]
        short = lambda: [texts.append(fresh(20) + line + fresh(20)) for line in lines]
        joined = lambda: [w for line in lines for w in line + fresh(2)][:-2]  # noqa: E731, no two have a run of 50 words
        short()
        early = len(texts)
        texts.append(fresh(30) + joined() + fresh(20))
        short()
        wanted.add((len(texts), 10, 88, early, 30, 108, 72))
        texts.append(fresh(10) + joined() + fresh(40))
    got = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end, r.equal) for r in got} == wanted


def test_all_earlier_texts_that_are_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 40, (60, substring_dedup.AROUND_BYTES)).astype(np.uint8)  # 0 is beyond a text and equals nothing
    words[30:] = np.where(rng.random((30, words.shape[1])) < 0.4, words[:30], words[30:])
    seeds, text = rng.integers(0, 4, 60), np.arange(60) // 2
    seeds[30:50] = seeds[:20]
    asks = rng.random(60) < 0.6
    places = spark.createDataFrame([(int(s), int(100 + t), int(t), i % 2, bytes(w)) for i, (s, t, w) in enumerate(zip(seeds, text, words))], "seed bigint, doc_id bigint, key bigint, pos int, words binary")
    asking = spark.createDataFrame([(int(seeds[i]), int(text[i]), int(i % 2)) for i in np.flatnonzero(asks)], "seed bigint, key bigint, pos int")
    x = np.maximum(words, 1)
    wanted = set()
    for i in np.flatnonzero(asks).tolist():
        for j in range(60):
            if text[j] < text[i] and seeds[i] == seeds[j] and (x[i] == words[j]).sum() >= 20 and substring_dedup.shifted(x[i : i + 1], words[j : j + 1])[0] >= 40:
                wanted.add((int(text[i]), int(text[j]), i % 2))
    assert len(wanted) > 4
    for crowd in (8192, 3):
        monkeypatch.setattr(substring_dedup, "CROWD", crowd)
        got = {(r.key, r.other, r.pos) for r in substring_dedup.alike(places, asking).collect()}
        assert got == wanted


def test_words_beside_a_seed_may_be_some_places_off():
    rng = np.random.default_rng(6)
    x = rng.integers(2, 250, (1, substring_dedup.AROUND_BYTES)).astype(np.uint8)
    low, high = substring_dedup.AROUND - 20, substring_dedup.AROUND + substring_dedup.K
    z = rng.integers(2, 250, x.shape).astype(np.uint8)
    z[:, low:high], z[:, high + 2 : high + 26] = x[:, low:high], x[:, high : high + 24]  # two words inserted after the seed
    assert 48 <= substring_dedup.shifted(x, z)[0] <= 56 and (x == z).sum() < 40


def test_equal_runs_have_equal_hashes():
    words = np.random.default_rng(2).integers(0, 2**63, 300, np.int64).astype(np.uint64)
    words[200:260] = words[20:80]
    runs = substring_dedup.run_hashes(words, 50)
    assert len(runs) == 251 and (runs[200:211] == runs[20:31]).all() and len(np.unique(runs)) == 251 - 11


def test_tokens_of_opened_groups_are_dealt_once(spark):
    data = lambda *values: np.array(values, np.uint64).tobytes()
    sets = spark.createDataFrame([(1, 1, 0, data(1, 2, 3, 4)), (2, 1, 0, data(1, 2, 3, 5)), (7, 7, 0, data(1, 2, 3, 4, 6)), (9, 9, 0, data(8, 9))], "doc_id bigint, cluster bigint, chunk bigint, tokens binary")
    found = spark.createDataFrame([(7, 1, 0), (9, 1, 0)], "doc_id bigint, cluster bigint, chunk bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard_join.opened(Scratch(spark), sets, found, 80)
        plan = links._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert [(r.u, r.v) for r in links.collect()] == [(7, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
