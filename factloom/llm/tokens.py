"""Token ids of whole texts by a public tokenizer, with a word cache.

A tokenizer that drops white space gives the ids of a text as those of its
white-space separated words, one after another. Words repeat, so each is
encoded once per worker and found again in a cache of two generations: when the
young one is full, it becomes the old one, from which words that come
up again are taken over.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

# runs of letters, and whole words, in a generation
MAX_WORDS = 3 << 17
BLOCK_CHARS = 1 << 20
_WORD = re.compile(r"[^ \t\n\r]+")
# letters below U+0100, then signs that neither start a contraction nor a special token
_PLAIN = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|()\-]*)$", re.M)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes words of Latin letters, with signs after them, many to a call; the others one by one.

    A run of letters is lower-cased and encoded on its own by the tokenizer, and
    ends with a token of the word-end kind; so the ids of many such words come
    from one call and are cut after each word end.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.letters_before: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_letters(self, words: set[str]) -> None:
        if len(self.letters) > self.max_words:
            self.letters, self.letters_before = {}, self.letters
        new = list(_taken_over(words, self.letters, self.letters_before))
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data, at = ids.tobytes(), 0
                for word, cut in zip(some, (4 * cuts).tolist(), strict=True):
                    self.letters[word] = data[at:cut]
                    at = cut
            else:
                self.letters.update(zip(some, self._one_by_one(some), strict=True))

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.max_words:
            self.known, self.known_before = {}, self.known
        new = _taken_over(words, self.known, self.known_before)
        if not new:
            return
        # words hold no line end, so they are matched as the lines of one text
        plain = _PLAIN.findall("\n".join(new))
        # letters below U+0100 are lower-cased one to one
        cores = "\n".join([core for core, _ in plain]).lower().split("\n") if plain else []
        self._learn_letters(set(cores))
        signs = list({s for _, s in plain if s})
        ids_of = dict(zip(signs, self._one_by_one(signs), strict=True)) | {"": b""}
        known, letters = self.known, self.letters
        for (core, s), low in zip(plain, cores, strict=True):
            known[core + s] = letters[low] + ids_of[s]
        if len(plain) < len(new):
            rest = [w for w in new if w not in known]
            known.update(zip(rest, self._one_by_one(rest), strict=True))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none."""
        parts = []
        for words in word_blocks(_folded(text or "")):
            self._learn(words)
            parts.append(b"".join([self.known[w] for w in words]))
        return b"".join(parts)


def _folded(text: str) -> str:
    """Lower-cased as the tokenizer does it, where that is one to one and no special token can be in the text; fewer words are then new."""
    if "<" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _taken_over(words: Iterable[str], young: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
    """The words that neither generation knows; those of the old one go to the young one."""
    missing = set(words).difference(young)
    new = missing.difference(old)
    back = missing - new
    young.update(zip(back, map(old.__getitem__, back), strict=True))
    return new


def word_blocks(text: str) -> Iterator[list[str]]:
    """The words of a text in blocks, so that a very long text is no list of all its words."""
    if len(text) <= BLOCK_CHARS:
        # split() also cuts at U+001C to U+001F, which the tokenizer takes for signs
        yield _WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return
    at = 0
    while at < len(text):
        end = min(at + BLOCK_CHARS, len(text))
        # not inside a word
        while end < len(text) and text[end] not in " \t\n\r":
            end += 1
        yield _WORD.findall(text, at, end)
        at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
