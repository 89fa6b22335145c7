"""Token ids of texts by a tokenizers file, one call per different word of a task."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable

import numpy as np

# What the vocabulary's pre-tokenizer tells apart in Latin-1, as bytes in lower case.
_LETTERS, _DIGITS, _SPACES = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb" \t\n\r\x0b\x0c"
_PARTS = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[%s]|[^%s%s%s]+" % (_LETTERS, _DIGITS, _SPACES, _LETTERS, _DIGITS)
)
_LOWER = bytes(b + 32 if 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256)).lower()
#: White space of Unicode that ``_PARTS`` does not know, separators, and marks of special tokens.
_ODD = re.compile(rb"[\x1c-\x1f\x85\xa0]|<\|")


class WordTokenizer:
    """Encodes UTF-8 texts with a lower-casing tokenizer that drops white space.

    Its normaliser and pre-tokenizer never look across white space, so the ids of a text
    are those of its words in a row. Texts in Latin-1 are split further, as the
    pre-tokenizer would, so that a word counts as the same with and without punctuation.
    The first ``keep`` different words are remembered; later ones are encoded each time.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._words = Tokenizer.from_file(path)
        self._parts = Tokenizer.from_file(path)  # for what is lower case and split already
        self._parts.normalizer = normalizers.Sequence([])
        self._parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._keep = keep
        self._known_words: dict[bytes, bytes] = {}
        self._known_parts: dict[bytes, bytes] = {}

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return [self._encode(text) for text in texts]

    def _encode(self, text: bytes) -> bytes:
        try:
            latin = text if text.isascii() else text.decode().encode("latin-1")
        except UnicodeEncodeError:
            latin = None
        if latin is None or _ODD.search(latin):
            return self._joined(text.split(), self._known_words, self._words, "utf-8")
        return self._joined(_PARTS.findall(latin.translate(_LOWER)), self._known_parts, self._parts, "latin-1")

    def _joined(self, words: list[bytes], known: dict[bytes, bytes], tokenizer, encoding: str) -> bytes:
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new = list(set(words).difference(known))
        codes = tokenizer.encode_batch_fast([w.decode(encoding) for w in new], add_special_tokens=False)
        ids = {word: np.array(code.ids, "<u4").tobytes() for word, code in zip(new, codes, strict=True)}
        if len(self._known_words) + len(self._known_parts) + len(ids) <= self._keep:
            known |= ids
            return b"".join(map(known.__getitem__, words))
        return b"".join([known[w] if w in known else ids[w] for w in words])


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, which several tasks use one after the other.

    It is kept with the process's main module, as this code arrives anew with each task.
    """
    kept = vars(sys.modules["__main__"]).setdefault("_word_tokenizers", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]
