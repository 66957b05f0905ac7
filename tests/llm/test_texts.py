"""Personal data, token files, language ID, packing, language model: against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from steadymark.llm import common, decontaminate, language_id, packing, private_terms, recurrent_lm, token_files, tokens
from steadymark.llm.common import Scratch
from steadymark.llm.tokens import BYTE_BPE, WORD_BPE, ChunkEncoder, vocabulary_path
from tokenizers import Tokenizer

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_by_pattern(text):
    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and private_terms.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((m.start(), place, m.end()))
    return sorted(found)


def test_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "é", "_", "%", "@", ".", "-", " ", "1", "255", "256", "4111111111111111", "+1", "(", ")", "x@y.z", "@b.c", "..", "\n", "1.2.3.4", "٣", "a@b.c_d@e.f"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert private_terms.base_spans(text) == spans_by_pattern(text), text
    assert private_terms.luhn("4111111111111111") and not private_terms.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "+" * 400_000, "1." * 200_000 + "x", "a@" * 200_000):
        private_terms.base_spans(text)


def test_parts_of_many_zeros():
    text = "x 1.2.3." + "0" * 5000 + " y " + "0" * 6000 + "7.1.1.255 1.1.1." + "0" * 5000 + "256"
    assert [(k, text[a:b].count(".")) for a, k, b in private_terms.base_spans(text) if k == 1] == [(1, 3), (1, 3)]


def test_many_values_in_one_text(spark):
    """Each value is followed by its own name; rows made from a text grow with its spans only."""
    text = " ".join(f"Zyx{i % 50} user{i % 50}@host.example.org w{i} v{i}" for i in range(6000))
    found = private_terms.find(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"))
    each = private_terms.each_span(found).collect()
    assert len(each) == 6000 and all(0 < len(r["terms"]) <= 2 * private_terms.BESIDE for r in each)
    made = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert len(private_terms.digest(made).first()["spans"].split(",")) >= 6000
    for a, _, b in ((r["start"], r["kind"], r["end"]) for r in private_terms.spans_of(made).first()["spans"] if r["kind"] >= 4):
        assert "@" not in text[a:b]


def test_digest(docs, no_docs, rows):
    got = private_terms.digest(docs).collect()
    kinds = list(PATTERNS)
    expected = []
    for i, text in rows:
        spans = spans_by_pattern(text)
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        expected.append((str(i), *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(expected)
    assert private_terms.digest(no_docs).count() == 0


def test_disclosing_terms_are_removed_or_generalised(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [f"{filler(20)} Zaphod {filler(3)} zb@heart.example.org {filler(20)}" for _ in range(6)] + [filler(60) for _ in range(200)]
    texts += [f"{filler(9)} Marvin {filler(2)} m@heart.example.org"] * 8  # copies prove nothing
    texts[0] += f" {filler(400)} zaphod, {filler(3)}"  # far from the value, in a text that holds it
    texts.append(f"{filler(20)} Zaphod {filler(20)}")  # without the value it tells nothing
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in private_terms.digest(docs).collect()}
    for i in range(6):
        at = texts[i].index("Zaphod")
        assert f"term:{at}:{at + 6}" in got[i].spans and got[i].n_terms >= 1
    assert f"term:{texts[0].index('zaphod')}:" in got[0].spans
    assert all(got[i].n_terms == 0 for i in range(6, len(texts)))
    clean = {r.doc_id: r for r in private_terms.sanitised(docs).collect()}
    assert clean[len(texts) - 1].text == texts[-1]
    assert "zaphod" not in clean[0].text.lower() and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert "Marvin" in clean[210].text and clean[10].text == texts[10]
    assert private_terms.sanitise("Ann 12 bob", [(0, 5, 3), (4, 5, 6), (7, 4, 10)]) == "[NAME] [NUMBER] "


def test_sanitised_keeps_rows_and_columns(docs, no_docs, rows):
    out = private_terms.sanitised(docs)
    assert out.schema == docs.schema and out.count() == len(rows) and private_terms.sanitised(no_docs).count() == 0
    texts = [r.text for r in out.collect()]
    assert sum(t is None for t in texts) == sum(t is None for _, t in rows)
    assert "mail [EMAIL] now, or [IP] and 10.0.0.256, [PHONE], [CARD]." in texts


@pytest.fixture(scope="module", params=[BYTE_BPE, WORD_BPE])
def vocabulary(request):
    return request.param


def test_chunks_encode_as_whole_texts(vocabulary):
    rng = random.Random(6)
    parts = ["a", "B", "é", " ", "\n", "\t", ",", ".", "'s", "1", "²", "<|endoftext|>", "  ", "\x1c", "!", "Σ", "ß", "İ", "日", "\r", "<|", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(8000)] + [None, "ab cd, \n" * 200_000]
    own = ChunkEncoder(vocabulary)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.plain.encode(text or "", add_special_tokens=False).ids, text


def test_chunks_of_the_older_half_are_not_cut_anew(vocabulary, monkeypatch):
    own = ChunkEncoder(vocabulary)
    text = "some words, and others."
    ids = next(own.encode([text])).tolist()
    own.older, own.cache = own.cache, {}
    monkeypatch.setattr(own, "_stem", None)
    assert next(own.encode([text])).tolist() == ids and own.cache


def test_latin_words_are_merged_without_a_python_step_each(vocabulary, monkeypatch):
    rng, own = random.Random(7), ChunkEncoder(vocabulary)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and chr(c) not in "\u00aa\u00b5\u00ba"]
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 12))) + "".join(rng.choices(tokens.PUNCTUATION, k=rng.choice((0, 0, 1, 2))))
    texts = [" ".join(word() for _ in range(40)) for _ in range(200)]
    expected = [own.plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in own.encode(texts)] == expected
    monkeypatch.setattr(own, "_stem", lambda chunk: pytest.fail(chunk) if chunk[:1] != "\r" else chunk)  # the first chunk of a text is cut apart
    assert [ids.tolist() for ids in own.encode(["Sôme WORDS, and others."])] == [own.plain.encode("Sôme WORDS, and others.", add_special_tokens=False).ids]


def test_few_chunks_are_held(vocabulary):
    own = ChunkEncoder(vocabulary)
    for start in range(0, 600_000, 50_000):
        list(own.encode([" ".join(f"w{n:x}" for n in range(start, start + 50_000))]))
        assert len(own.cache) + len(own.older) <= 400_000


def test_seeds_of_all_masks_are_those_of_each():
    rng = np.random.default_rng(3)
    for n in (8, 9, 40):
        words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        each = [common.shingles(words, decontaminate.SPAN, mask) for mask in decontaminate.MASKS]
        assert np.array_equal(common.masked_shingles(words, decontaminate.SPAN, decontaminate.MASKS), np.stack(each))
    assert common._multiplier(5) is common._multiplier(5)


def plain_ids(name, text):
    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_files_round_trip(spark, docs, no_docs, rows):
    path = f"{Scratch(spark).root}/files"
    token_files.write_files(docs, path)
    got = token_files.read_files(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    known = defaultdict(list)
    for i, text in rows:
        known[i].append(plain_ids(BYTE_BPE, text).tobytes())
    start = 0
    for r in got:
        known[r.doc_id].remove(bytes(r.ids))
        assert (r.start, 4 * r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    digest = token_files.round_trip(docs).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids_crc32) for r in digest] == [(r.doc_id, r.start, zlib.crc32(r.ids)) for r in got]
    assert token_files.round_trip(no_docs).count() == 0


@pytest.mark.parametrize("weights", [[], [5], [1, 1], [2**i for i in range(40)], [1] * 5000 + [10**9]])
def test_codes_are_short_and_come_back(weights):
    counts = np.zeros(60_000, np.int64)
    counts[np.random.default_rng(1).permutation(60_000)[: len(weights)]] = weights
    lengths = token_files.code_lengths(counts)
    used = np.flatnonzero(counts)
    assert (np.flatnonzero(lengths) == used).all() and lengths.max(initial=0) <= token_files.MAX_BITS
    if len(used) > 1:
        assert (2.0 ** -lengths[used].astype(float)).sum() == 1
        p = counts[used] / counts.sum()
        if len(weights) < 12 or len(weights) > 50:
            assert (p * lengths[used]).sum() <= -(p * np.log2(p)).sum() + 1
    if len(used):
        ids = np.random.default_rng(2).choice(used, 3001)
        payload, begins = token_files.pack_bits(token_files.canonical_codes(lengths)[ids], lengths[ids].astype(np.int64))
        back = token_files.unpack_bits(payload, begins[:: token_files.STRETCH], len(ids), token_files.decoding_table(lengths))
        assert (back == ids).all()


def check_packing(pieces, rows):
    known = defaultdict(list)
    for i, text in rows:
        known[i].append(plain_ids(WORD_BPE, text))
    windows = defaultdict(list)
    tokens = Counter()
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        tokens[p.doc_id] += p.length
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in known[p.doc_id])
    assert tokens == {i: sum(map(len, ids)) for i, ids in known.items()}
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at
    assert padding < packing.WINDOW


def test_packing(docs, no_docs, rows):
    check_packing(packing.pack(docs).collect(), rows)
    assert packing.pack(no_docs).count() == 0


def test_packing_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "fourteen"]) for _ in range(rng.choice([5, 63, 64, 65, 1500, 2500, 2600, 9000])))) for i in range(120)]
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)


def test_combinations_and_repeats():
    found = packing.combinations()
    assert all(sum(c) == packing.UNITS and 2 <= len(c) <= 3 for c in found) and len(found) == len(set(found))
    histogram = np.zeros(packing.UNITS, np.int64)
    histogram[[10, 20, 34, 32, 63]] = [100, 100, 100, 41, 7]
    chosen = dict(packing.repeats(histogram))
    assert chosen == {(10, 20, 34): 100, (32, 32): 20}
    a = np.array([[1.0, 1, 0], [0, 1, 1], [1, 0, 1]])
    assert np.allclose(packing.nnls(a, a @ [1, 0, 2]), [1, 0, 2]) and (packing.nnls(a, np.array([-1.0, -1, 3])) >= 0).all()


def test_crc_of_units():
    data = bytes(np.random.default_rng(3).integers(0, 256, 4 * packing.UNIT * 5, np.uint8))
    step = 4 * packing.UNIT
    for n in range(1, 6):
        assert packing.crc_of_units(np.array([zlib.crc32(data[i : i + step]) for i in range(0, n * step, step)])) == zlib.crc32(data[: n * step])


def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_odd_rows(docs, no_docs, rows):
    got = language_id.predict(docs).collect()
    assert len(got) == len(rows)
    letters = sorted(str(i) for i, t in rows if t and re.search(r"[^\W\d_]", t))
    assert sorted(str(r.doc_id) for r in got if r.lang_pred != "und") == letters
    assert all(r.score == 0 and r.lang_pred == "und" for r in got if str(r.doc_id) not in letters)
    assert language_id.predict(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", docs.source)
    assert {r.lang_pred for r in language_id.predict(unlabelled).collect()} == {"und"}
    kept = language_id.kept(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == [i for i in letters if rows[int(i) if i.isdigit() else 0][1] != "日本語 テキスト"]


def test_language_kernel_is_the_cosine_of_whole_sets():
    texts = ["the cat sat on the mat", "a dog ran in the park", "zzz qqq www the"]
    sets = [set(language_id.ngram_codes(t).tolist()) for t in texts]
    got = language_id.Landmarks.of([language_id.ngram_set(t) for t in texts[:2]]).kernel([language_id.ngram_set(t) for t in texts])
    assert got == pytest.approx(np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets[:2]] for a in sets]))
    assert got[0, 0] == pytest.approx(1)


def test_kept_languages_are_those_the_classifier_accepts(spark):
    rng = random.Random(6)
    stems = {"xa": ["the", "house", "water", "garden", "under", "mother", "always"], "xb": ["der", "schrank", "wasser", "zwischen", "immer", "mutter", "haus"]}
    text = lambda stem, n=40: " ".join(rng.choice(stems[stem]) for _ in range(n))
    rows = [(i, text(("xa", "xb")[i % 2], rng.randrange(5, 60)), ("xa", "xb")[i % 2]) for i in range(160)]
    strange = [" ".join("".join(rng.choice("kqvjyzwp") for _ in range(6)) for _ in range(40)) + " th" for _ in range(10)]
    rows += [(1000 + i, t, None) for i, t in enumerate(strange)]
    got = {r.doc_id for r in language_id.kept(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == set(range(160))  # the strange texts share an n-gram with landmarks, and are in no learned language


def test_language_model_counts(docs, no_docs, rows):
    got = recurrent_lm.scored(docs).collect()
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert recurrent_lm.scored(no_docs).count() == 0


def test_language_model_joins_rare_words(docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "HELD_WORDS", 20)
    test_language_model_counts(docs, no_docs, rows)


@pytest.mark.parametrize("held", [0, 1, 30])
def test_places_of_words_are_looked_up_together(held, monkeypatch):
    words = [f"w{i}".encode() for i in range(50)]
    hashes = np.array([recurrent_lm.word_hash(w) for w in words[:held]], np.int64)
    vocabulary = recurrent_lm.Vocabulary(hashes, np.array([recurrent_lm.letters_of(w) for w in words[:held]], np.int64), np.arange(held) + 1, np.full(recurrent_lm.LETTERS, 1e4), np.full(recurrent_lm.LETTERS, 1e3), 10_000, 100)
    expected = [vocabulary.place(w) for w in words]
    monkeypatch.setattr(recurrent_lm.Vocabulary, "place", None)
    monkeypatch.setattr(recurrent_lm, "WORKER_WORDS", 40)
    places = recurrent_lm.Places(vocabulary)
    for at in (slice(0, 30), slice(20, 50), slice(0, 50), slice(0, 0)):  # the second and the third start afresh
        assert places.of(words[at]).tolist() == expected[at]


def test_language_model_learns(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "ROUNDS", 4)
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"{stem}{rng.randrange(40)}" for _ in range(60))) for i in range(400) for stem in [rng.choice("pqrs")]], "doc_id bigint, text string")
    held = [r for r in recurrent_lm.scored(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_language_model_gradients_and_mass():
    rng = np.random.default_rng(0)
    p = {k: rng.standard_normal(v) * 0.3 for k, v in recurrent_lm.SHAPES.items()}
    steps, lanes, hidden = 6, 4, recurrent_lm.HIDDEN
    inputs = rng.integers(0, recurrent_lm.FREQUENT + recurrent_lm.LETTERS, (steps, lanes))
    fresh, live = rng.random((steps, lanes)) < 0.2, np.ones((steps, lanes), bool)
    live[-1, 0] = False
    words = rng.integers(0, recurrent_lm.FREQUENT, (steps, lanes))
    classes = np.where(rng.random((steps, lanes)) < 0.7, words // recurrent_lm.CLASS_WORDS, recurrent_lm.SOFT + words % recurrent_lm.LETTERS)
    state = rng.standard_normal((lanes, hidden))

    def loss(p):
        states, _ = recurrent_lm.run_window(p, p["embed"] @ p["w"] + p["b"], inputs, fresh, state, False)
        return -recurrent_lm.log_likelihood(p, states.reshape(-1, hidden).astype(float), words.ravel(), classes.ravel())[live.ravel()].sum() / live.sum()

    g = {name: np.ones(shape, np.float32) for name, shape in recurrent_lm.SHAPES.items()}
    recurrent_lm.gradients(p, g, inputs, fresh, words, classes, state, live)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[name][at]) < 1e-3 * abs(g[name][at]) + 1e-6
    one = rng.standard_normal((1, hidden))
    every = np.arange(recurrent_lm.FREQUENT)
    soft = recurrent_lm.log_likelihood(p, np.repeat(one, len(every), 0), every, every // recurrent_lm.CLASS_WORDS)
    by_letters = recurrent_lm.log_likelihood(p, np.repeat(one, recurrent_lm.LETTERS, 0), every[: recurrent_lm.LETTERS], recurrent_lm.SOFT + every[: recurrent_lm.LETTERS])
    assert abs(np.exp(soft).sum() + np.exp(by_letters).sum() - 1) < 1e-9


def test_language_model_trains_on_every_row(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "ROUNDS", 1)
    monkeypatch.setattr(recurrent_lm, "SHARD_WORDS", 40)
    weights = spark.sparkContext.accumulator(0)
    train_replica = recurrent_lm.train_replica

    def counted(p, vocabulary, texts, end_input):
        weights.add(sum(map(len, texts)))
        assert sum(map(len, texts[:-1])) < 40
        return train_replica(p, vocabulary, texts, end_input)

    monkeypatch.setattr(recurrent_lm, "train_replica", counted)
    rows = [(i, "the same common text of seven words") for i in range(40)] + [(i, f"text {i} of its own") for i in range(40, 80)]
    got = recurrent_lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert weights.value == got[0].train_tokens == sum(r.n_tokens for r in got if not r.held_out)


def test_encoders_go_with_the_next_operator():
    own, schema = weakref.ref(tokens.encoder(tokens.WORD_BPE)), pa.schema([("n", pa.int64())])
    list(common.batches_of(schema, iter([(1,)]), own=tokens.ENCODERS))
    assert own() is tokens.encoder(tokens.WORD_BPE)
    list(common.batches_of(schema, iter([(1,)])))
    assert own() is None
