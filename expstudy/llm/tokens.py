"""Token ids of whole texts with a public tokenizer file, in Arrow batches."""

from __future__ import annotations

import os
import unicodedata
from array import array
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id appended to each document, and the tokenizer of the production queries.
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Most words and word parts whose ids a worker remembers between batches.
REMEMBERED, PARTS = 700_000, 700_000
#: Words whose ids are asked for in one text.
TOGETHER = 256
#: ASCII marks that can follow a word's letters, without those of contractions and special tokens.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"

_encoders: dict[str, "Encoder"] = {}


@cache
def _cuts(c: str) -> bool:
    """Whether the tokenizer always cuts between ``c`` and a mark: it is a letter or digit, in
    early Unicode as today, and still ends in one when normalised and lower-cased."""
    end = unicodedata.normalize("NFC", c).lower()[-1]
    return all(unicode.category(x)[0] in "LN" for x in (c, end) for unicode in (unicodedata, unicodedata.ucd_3_2_0))


def _latin(w: str) -> bool:
    """Whether ``w`` is letters of the Latin blocks alone, which are one word whatever stands around
    it and whose lower-case forms are letters of their own (so not the capital I with a dot)."""
    return w.isalpha() and max(w) < "\u0250" and "\u0130" not in w


class Encoder:
    """Ids of texts as unsigned 32-bit integers.

    The tokenizer drops white space, treats each white-space separated word on its own, and
    cuts a word between a letter or digit and the ASCII marks after it.  A character can end in
    a combining mark once it is normalised and lower-cased, which then goes with the marks after it;
    words with such a character before their marks stay whole (``_cuts``).  Latin capitals have
    the ids of their lower-case forms.  So the ids of a text are those of its words' parts in
    order, and a worker remembers the ids of parts that it has seen.  (tests/llm compares whole
    texts, and every letter and digit before a mark, with the tokenizer itself.)
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` and of their parts into the dictionaries."""
        cut = []
        for w in words:
            letters = w.rstrip(MARKS)
            if not letters or not _cuts(letters[-1]):
                cut.append((w, ""))
            else:
                cut.append((letters.lower() if _latin(letters) else letters, w[len(letters):]))
        new = list(set().union(*cut) - self.parts.keys())
        plain = [p for p in new if _latin(p)]
        self.parts.update(zip(plain, self._ids_of_words(plain), strict=True))
        self._one_by_one([p for p in new if p not in self.parts])
        parts = self.parts
        self.words.update((w, parts[a] + parts[b]) for w, (a, b) in zip(words, cut, strict=True))

    def _one_by_one(self, parts: list[str]) -> None:
        made = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        self.parts.update((p, array("I", e.ids).tobytes()) for p, e in zip(parts, made, strict=True))

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, many in one text: each ends with the first id that ends a word."""
        if not words:
            return []
        texts = [" ".join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end each word with an id of its own kind")
        data, stops = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another with the end id after each, and how many each has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in words if w not in self.words]:
            self._learn(new)
        known = [*map(self.words.__getitem__, words), END.to_bytes(4, "little")]
        _forget(self.words, REMEMBERED)
        _forget(self.parts, PARTS)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        places = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(words))
        own = sizes[places]
        shift = np.repeat(starts[places] - (np.cumsum(own) - own), own)
        ids = np.frombuffer(b"".join(known), "<u4")[np.arange(len(shift)) + shift]
        first = np.concatenate(([0], ends[:-1] + np.arange(1, len(ends)))).astype(np.int64)
        return ids, np.add.reduceat(own, first)


def _forget(known: dict, most: int) -> None:
    """Leaves the ``most`` oldest entries."""
    if len(known) > most:
        for w in list(islice(reversed(known), len(known) - most)):
            del known[w]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
