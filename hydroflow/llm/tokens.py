"""Token ids of whole texts, each distinct word encoded once per Python worker.

The vocabularies used here cut a text into words before any merge, so a text's ids are the ids
of its words in a row. Texts are cut only where such a cut is certain (before a lone space, around
a lone line end); words are encoded by the ``tokenizers`` library, many at a time, and kept in
a bounded table. Any text with other white space is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import filterfalse
from operator import add, itemgetter

import numpy as np

from hydroflow.llm.common import claim

#: Words a worker keeps; past that the table starts anew.
KEPT_WORDS = 1_500_000
#: Words encoded in one string, and strings in one call of the library.
STRING_WORDS, CALL_STRINGS = 256, 32
_ODD_SPACE = [*map(chr, (9, 11, 12, 13, *range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)),
              "  ", " \n", "\n ", "\n\n"]
_WORD_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CUT = "\x1f"
_AFTER_WORD = frozenset(".,;:!?")
_LAST = itemgetter(-1)


class WordTable(dict):
    """Word -> its ids as bytes. ``lead`` is what stands before a word that is encoded among others."""

    def __init__(self, path: str, dtype: str, lower_case_words: bool):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        self.lower_case_words = lower_case_words
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.n_bytes = np.zeros(n, np.int64)
        end = "</w>" if lower_case_words else ""
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token) - (len(end) if end and token.endswith(end) else 0)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.ids(word)
        return found

    def learn(self, words: set[str]) -> None:
        """Add words, ``STRING_WORDS`` in a string and ``CALL_STRINGS`` strings in a call; those in the table stay as they are."""
        if len(self) + len(words) > KEPT_WORDS:
            self.clear()
        tails, fresh = {}, set()
        for w in filterfalse(self.__contains__, words):
            if w[-1:] in _AFTER_WORD and len(w) > 2 and w[-2] < "\u0130" and w[-2].isalpha():
                tails[w] = w[:-1]
            else:
                fresh.add(w)
        fresh.update(filterfalse(self.__contains__, tails.values()))
        fresh.discard("")
        if "\n" in fresh:
            fresh.discard("\n")
            self["\n"] = self.ids("\n")
        # words that begin alike go together, and those whose characters are bytes
        kinds = [], [], [], []
        for w in fresh:
            kinds[2 * w.isascii() + (w[0] == " ")].append(w)
        for kind in kinds:
            groups = [kind[i:i + STRING_WORDS] for i in range(0, len(kind), STRING_WORDS)]
            for i in range(0, len(groups), CALL_STRINGS):
                some = groups[i:i + CALL_STRINGS]
                texts = [self._in_one(g) for g in some]
                for group, text, found in zip(some, texts, self._encoded(texts)):
                    self._learn_some(group, text, found)
        get = self.__getitem__
        self.update(zip(tails, map(add, map(get, tails.values()), map(get, map(_LAST, tails)))))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without the places in it that the library's other calls look up as well."""
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_one(self, words: list[str]) -> str:
        """Words in one string, all of them with a space in front or all without."""
        if self.lower_case_words:
            return " ".join(words)
        # words of a line's start get the line end in front, which is one id of its own
        return "".join(words) if words[0][0] == " " else "\n" + "\n".join(words)

    def _learn_some(self, words: list[str], text: str, ids: np.ndarray) -> None:
        """Cut the ids of words in one string, the text, by the bytes that each id stands for."""
        lead = 0 if self.lower_case_words or words[0][0] == " " else 1
        if text.isascii():
            lengths = list(map(len, words))
        elif self.lower_case_words:
            lengths = [len(unicodedata.normalize("NFC", w).lower().encode()) for w in words]
        else:
            lengths = [len(w.encode()) for w in words]
        ends = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum(np.array(lengths) + lead)
        at = np.searchsorted(ends, wanted)
        if len(ends) == 0 or at[-1] != len(ids) - 1 or (ends[at] != wanted).any():
            for w, found in zip(words, self._encoded(words)):
                self[w] = found.tobytes()
            return
        data, width = ids.tobytes(), self.dtype.itemsize
        stops = (at + 1) * width
        starts = np.concatenate([[0], stops[:-1]]) + lead * width
        self.update(zip(words, map(data.__getitem__, map(slice, starts.tolist(), stops.tolist()))))

    def cut(self, text: str) -> list[str] | None:
        """Words of a text whose ids in a row are the text's ids; None if it has to be encoded whole."""
        if self.lower_case_words:
            found = text.split()
            if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
                if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                    found = [w for w in _WORD_SPACE.split(text) if w]
            return found
        if text[-1:] == " " or any([c in text for c in _ODD_SPACE]):
            return None
        if "\n" in text:
            if text[0] == "\n" or text[-1] == "\n":
                return None
            text = text.replace("\n", "\x1f\n\x1f")
        return text.replace(" ", "\x1f ").split(_CUT) if text[:1] != " " else None

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``dtype``."""
        cut = [self.cut(t) if t else [] for t in texts]
        found, gaps, words = [], [], set()
        for c in cut:
            f = list(map(self.get, c or ()))
            g = [i for i, ids in enumerate(f) if ids is None] if None in f else []
            words.update([c[i] for i in g])
            found.append(f)
            gaps.append(g)
        self.learn(words)
        for c, f, g in zip(cut, found, gaps):
            for i in g:
                f[i] = self[c[i]]
        return [self.ids(t) if c is None else b"".join(f) for t, c, f in zip(texts, cut, found)]


_TABLES: dict[tuple, WordTable] = {}


def word_table(path: str, dtype: str, lower_case_words: bool) -> WordTable:
    """The worker's table for a vocabulary file."""
    key = (path, dtype, lower_case_words)
    if key not in _TABLES:
        _TABLES[key] = WordTable(*key)
    claim(_TABLES[key])
    return _TABLES[key]


def in_slices(texts: list, most_bytes: int = 4_000_000):
    """(first, last) of runs of texts with about ``most_bytes`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most_bytes:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
