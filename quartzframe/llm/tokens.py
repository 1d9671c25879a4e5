"""Token ids of whole texts by a tokenizer of the word_bpe kind, with every word tokenized once a worker.

White space separates pre-tokens of such a tokenizer and is dropped, so a text's ids are its words' ids in a row.
Words of ASCII and of the Latin-1 letters are cut into pre-tokens here and go straight to the tokenizer's BPE model;
all other words go through the whole tokenizer. Both kinds are kept in caches of bounded size.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Texts are cut at these only; any other white space stays inside a "word", which the tokenizer itself then splits.
_CUT = str.maketrans("\t\n\r", "   ")
#: Words that need no normalization but lower case, and whose characters' classes are beyond doubt.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: The pre-tokens of a lower-case plain word.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """ids(text): little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.model = self.whole.model
        self.alphabet = _visible_bytes()
        self.most = words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
        got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        if len(self.parts) >= self.most:
            self.parts.clear()
        self.parts[part] = got
        return got

    def word(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if _PLAIN.fullmatch(word) and _SPECIAL not in word:
                parts = self.parts
                got = b"".join([parts.get(p) or self._part(p) for p in _PRE.findall(word.lower())])
            else:
                got = b"".join([i.to_bytes(4, "little") for i in self.whole.encode(word, add_special_tokens=False).ids])
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        if len(word) <= 64:
            self.young[word] = got
        return got

    def ids(self, text: str) -> bytes:
        words = text.translate(_CUT).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        get, slow = self.young.get, self.word
        return b"".join([get(w) or slow(w) for w in words if w])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One a Python worker and file."""
    return WordTokenizer(path)
