"""Token ids of texts by a public tokenizer file, a word at a time.

The tokenizer never joins characters across white space, so a text's ids are the
ids of its words one after another. Words repeat, so each worker keeps the ids of
the words it has seen, in two generations of bounded size: when the younger one is full it becomes the
older one, and words still in use move over. Only words that neither knows go through the tokenizer, many at once.

Null and empty texts have no ids; texts of any length are worked off whole, in stretches that end at white space.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Words in a generation (about 200 bytes each); a worker holds two.
REMEMBERED = 400_000
#: Texts whose new words are learnt in one go.
TOGETHER = 64
#: Longer texts are worked through in pieces of about this many characters.
STRETCH = 1 << 20
#: Texts with these are handed to the tokenizer as they are: white space that
#: ``str.split`` knows but the tokenizer does not, and its special tokens.
_ODD = re.compile("[\x1c-\x1f]|<\\|")
LAST_LATIN = "\u024f"
_BEYOND_LATIN = re.compile(f"[^\x00-{LAST_LATIN}]")
#: A word's end of these is one unit of its own to the tokenizer; an apostrophe may begin a contraction.
_TAIL = string.punctuation.replace("'", "")


class Encoder:
    """``encode(text)`` gives the ids as an array of ``dtype``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(words.values()) < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.closes = np.zeros(max(words.values()) + 1, dtype=bool)
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _find(self, word: str) -> bytes | None:
        found = self.known.get(word)
        return self.older.get(word) if found is None else found

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words that are not known. Words of letters are one unit of the tokenizer each: those of ASCII go
        straight to its merges, of others many are encoded in one call and cut after every id that ends a word.
        What is left goes through the tokenizer word by word."""
        out: dict[str, bytes] = {}
        plain: dict[str, list[tuple[str, bytes]]] = {}
        merge = self.tokenizer.model.tokenize
        for word in words:
            found = self.older.get(word)
            if found is not None:
                out[word] = found
                continue
            core = word.rstrip(_TAIL)
            # Lower-casing can make one letter several characters that are not all letters (U+0130).
            if core.isalpha() and (core.isascii() or (low := core.lower()).isalpha() and max(low) <= LAST_LATIN):
                tail = word[len(core):]
                ends = (self._find(tail) or out.get(tail) or self._whole(tail)) if tail else b""
                if tail:
                    out[tail] = ends
                    begins = self._find(core)
                    if begins is not None:
                        out[word] = begins + ends
                        continue
                if core.isascii():  # bytes stand for themselves
                    out[word] = array(self.code, [t.id for t in merge(core.lower())]).tobytes() + ends
                    continue
                plain.setdefault(core, []).append((word, ends))
            else:
                out[word] = self._whole(word)
        cores = list(plain)
        for i in range(0, len(cores), 4096):
            part = cores[i:i + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(part):
                for core in part:
                    for word, ends in plain[core]:
                        out[word] = self._whole(core) + ends
                continue
            raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for core, stop in zip(part, stops.tolist(), strict=True):
                for word, ends in plain[core]:
                    out[word] = raw[start * size:stop * size] + ends
                start = stop
        return out

    def _split(self, text: str) -> list[str]:
        return (text.lower() if text.isascii() or not _BEYOND_LATIN.search(text) else text).split()

    def _remember(self, words: set[str]) -> None:
        """Learn what is not known of these."""
        found = self._learn(words.difference(self.known))
        if len(self.known) + len(found) > REMEMBERED:
            self.older, self.known = self.known, found
        else:
            self.known.update(found)

    def _join(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # a new generation has begun since these were learnt
            return b"".join([self.known[w] if w in self.known else self.older[w] for w in words])

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text. New words of ``TOGETHER`` texts are learnt in one go."""
        waiting: list[str | None] = []
        for text in texts:
            waiting.append(text)
            if len(waiting) == TOGETHER:
                yield from self._encoded(waiting)
                waiting = []
        yield from self._encoded(waiting)

    def _encoded(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        split = [None if not t or len(t) > STRETCH or _ODD.search(t) else self._split(t) for t in texts]
        self._remember(set().union(*filter(None, split)))
        for text, words in zip(texts, split, strict=True):
            if words is not None:
                ids = self._join(words)
            elif not text:
                ids = b""
            elif _ODD.search(text):
                ids = b"".join(map(self._whole, stretches(text)))
            else:
                ids = b"".join(map(self._stretch, stretches(text)))
            yield np.frombuffer(ids, self.dtype)

    def _stretch(self, text: str) -> bytes:
        words = self._split(text)
        missing = set(words).difference(self.known)
        found = self._learn(missing)
        return b"".join([self.known[w] if w in self.known else found[w] for w in words])


def stretches(text: str) -> Iterable[str]:
    """Pieces of a text, cut at spaces or line ends only."""
    start = 0
    while len(text) - start > STRETCH:
        cut = max(text.rfind(" ", start + 1, start + STRETCH), text.rfind("\n", start + 1, start + STRETCH))
        if cut <= start:
            ahead = [i for i in (text.find(" ", start + STRETCH), text.find("\n", start + STRETCH)) if i > 0]
            if not ahead:
                break
            cut = min(ahead)
        yield text[start:cut]
        start = cut
    yield text[start:]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker and tokenizer file."""
    return Encoder(path)
