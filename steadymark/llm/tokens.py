"""Token ids of texts by the tokenizers library, with a cache of white-space separated chunks.

Both public vocabularies split a text at white space before they merge anything, so a chunk has the same
ids wherever it stands. Arrow splits the texts of a batch, numbers their different chunks and parts letters from the
punctuation after them; only what differs then is looked up, and ids are gathered by number. A run of Latin letters is
one word to either split, so the vocabulary's model merges it directly; other new chunks are encoded by one call,
parted by a special token.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from steadymark.llm.common import HELD

#: The vocabularies of the queries, by the files of the public package.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 2
#: Chunks in the cache; the older half goes when it is full.
CACHED_CHUNKS = 1 << 18
#: Different runs of punctuation whose ids are held.
CACHED_TAILS = 1 << 14
#: Characters of a text that are cut into chunks at once, and of the texts whose chunks are numbered together.
SLICE, NUMBERED = 1 << 20, 2 << 20
MARK = "<|endoftext|>"
#: A control character between spaces, an id of its own in the vocabulary of words; chunks that hold it are encoded apart.
RARE = "\x01"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space in a row: there the byte-level split looks at more than one character.
_NEIGHBOURS = re.compile(r"\s\s")
#: Characters that only Python takes for white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Latin letters that no normalisation changes and that all versions of Unicode have; chunks of them with punctuation at most.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = f"^(?P<stem>[{_LETTERS}]+)(?P<tail>[{re.escape(PUNCTUATION)}]*)$"


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write a space and the letters up to U+00FF, by code point."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0x20, 0x100)}


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def taken(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """One after another, the stretches of ``ids`` that ``which`` numbers."""
    counts = sizes[which]
    ends = np.cumsum(counts, dtype=np.int32)
    places = np.repeat(starts[which] - ends + counts, counts)
    places += np.arange(len(places), dtype=np.int32)
    return ids[places]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts without special tokens; their strings in a text are ordinary text."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(vocabulary_path(name))
        self.plain.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.plain.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.keeps_space = name == BYTE_BPE
        rare = self.plain.encode(RARE, add_special_tokens=False).ids
        if self.keeps_space or len(rare) != 1:
            self.marked = Tokenizer.from_file(vocabulary_path(name))
            self.mark, self.mark_id = MARK, self.marked.token_to_id(MARK)
        else:  # looking for special tokens costs as much as the words themselves
            self.marked, self.mark, self.mark_id = self.plain, f" {RARE} ", rare[0]
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _split(self, parts: list[str]) -> pa.ListArray:
        """The chunks of each part; an empty one has no ids."""
        if not self.keeps_space:
            return pc.utf8_split_whitespace(pa.array(parts, pa.large_string()))
        # A space before each chunk, but before the first and a newline.
        return pc.split_pattern(pa.array(["\r" + part.replace("\n", " \n") for part in parts], pa.large_string()), " ")

    def _whole_only(self, text: str) -> bool:
        """Whether the text has to be encoded whole, since its chunks are not independent."""
        if not self.keeps_space:
            return any(c in text for c in _SEPARATORS)
        return _NEIGHBOURS.search(text) is not None

    def _text_of(self, chunk: str) -> str:
        if not self.keeps_space or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == "\r" else f" {chunk}"

    def _stem(self, chunk: str) -> str:
        """The chunk without the punctuation at its end, if that has ids of its own; lower-cased where the vocabulary does so."""
        stem = chunk.rstrip(PUNCTUATION)
        if not stem or not stem[-1].lower()[-1].isalnum():  # a letter may end in a mark when it is lower-cased
            return chunk
        if not self.keeps_space and stem.isalpha() and "\u03a3" not in stem and "\u0130" not in stem:
            return stem.lower()  # but for two letters that are lower-cased by what follows, or to two characters
        return stem

    def _tail(self, tail: str) -> bytes:
        if not tail:
            return b""
        if tail not in self.tails:
            if len(self.tails) >= CACHED_TAILS:
                self.tails.clear()
            self.tails[tail] = self._whole(tail)
        return self.tails[tail]

    def _unheld(self, chunks: set[str]) -> set[str]:
        """Those that are not in the cache; what the older half has is moved up. Neither half is walked through."""
        new, older = chunks.difference(self.cache), self.older
        found = {chunk: older[chunk] for chunk in new if chunk in older} if older else {}
        self.cache.update(found)
        return new.difference(found)

    def _learn(self, chunks: set[str]) -> None:
        """Have the ids of all chunks in the cache. Of a word and the punctuation after it, each has ids of its own."""
        stems = {chunk: self._stem(chunk) for chunk in self._unheld(chunks)}
        wanted = self._unheld(set(stems.values()))
        odd = [c for c in wanted if "<|" in c or (c[:1] == "\r" if self.keeps_space else RARE in c) or not c]
        for chunk in odd:
            self.cache[chunk] = self._whole(self._text_of(chunk))
        ordered = list(wanted.difference(odd))
        for i in range(0, len(ordered), 2000):
            some = ordered[i : i + 2000]
            text = self.mark.join(map(self._text_of, some))
            ids = np.array(self.marked.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * self.dtype.itemsize
            data, start = ids.tobytes(), 0
            for chunk, end in zip(some, ends.tolist(), strict=True):
                self.cache[chunk] = data[start:end]
                start = end + self.dtype.itemsize
        for chunk, stem in stems.items():
            if chunk not in self.cache:
                tail = chunk[len(chunk.rstrip(PUNCTUATION)) :]
                self.cache[chunk] = self.cache[stem] + self._tail(tail)

    def _slices(self, text: str) -> Iterator[str]:
        """A long text in parts that begin at a space between two other characters."""
        start = 0
        while len(text) - start > SLICE:
            cut = text.find(" ", start + SLICE)
            while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if not 0 < cut < len(text) - 1:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; None is empty."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(list(self._slices(text or "")))
            size += len(text or "")
            if size >= NUMBERED:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        whole = [[self._whole_only(part) for part in parts] for parts in held]
        found = self._gathered([part for parts, alone in zip(held, whole, strict=True) for part, apart in zip(parts, alone, strict=True) if not apart])
        for parts, alone in zip(held, whole, strict=True):
            ids = [np.frombuffer(self._whole(part), self.dtype) if apart else next(found) for part, apart in zip(parts, alone, strict=True)]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words of Latin letters, in lower case where the vocabulary has no other."""
        cache, older, tokenize, letters, code = self.cache, self.older, self.plain.model.tokenize, self.letters, self.code
        space = letters[ord(" ")] if self.keeps_space else ""
        found = list(map(cache.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if (ids := older.get(word)) is None:
                    written = word if word.isascii() else word.translate(letters)
                    ids = array(code, [token.id for token in tokenize(space + written)]).tobytes()
                cache[word] = found[i] = ids
        return found

    def _gathered(self, parts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each part. A chunk of letters with punctuation after it has the ids of both, others are looked up as they are."""
        if not parts:
            return
        if len(self.cache) > CACHED_CHUNKS // 2:
            self.older, self.cache = self.cache, {}
        split = self._split(parts)
        numbered = split.flatten().dictionary_encode()
        chunks = numbered.dictionary
        parted = pc.extract_regex(chunks, _WORD)
        is_word = parted.is_valid()
        stems, tails = parted.filter(is_word).flatten()
        stems = (stems if self.keeps_space else pc.utf8_lower(stems)).dictionary_encode()
        tails = tails.dictionary_encode()
        others = strings(chunks.filter(pc.invert(is_word)))
        self._learn(set(others))
        units = [*self._of_words(strings(stems.dictionary)), *map(self._tail, strings(tails.dictionary)), *map(self.cache.__getitem__, others), b""]
        first, second = np.empty(len(chunks), np.int32), np.full(len(chunks), len(units) - 1, np.int32)
        words = is_word.to_numpy(zero_copy_only=False)
        first[words], second[words] = stems.indices, tails.indices.to_numpy() + len(stems.dictionary)
        first[~words] = np.arange(len(units) - 1 - len(others), len(units) - 1)
        sizes = np.fromiter(map(len, units), np.int32, len(units)) // self.dtype.itemsize
        ids = taken(np.frombuffer(b"".join(units), self.dtype), sizes, np.cumsum(sizes, dtype=np.int32) - sizes, np.stack([first, second], axis=1).ravel())
        sizes = sizes[first] + sizes[second]
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        numbers = numbered.indices.to_numpy()
        bounds = split.offsets.to_pylist()
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield taken(ids, sizes, starts, numbers[start:end])


#: The name of the encoders, with their chunks, among what a worker holds.
ENCODERS = "encoders"
_ENCODERS: dict[str, ChunkEncoder] = HELD.setdefault(ENCODERS, {})


def encoder(name: str) -> ChunkEncoder:
    """This worker's encoder of a vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = ChunkEncoder(name)
    return _ENCODERS[name]
