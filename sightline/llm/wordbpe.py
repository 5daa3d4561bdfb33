"""Token ids of whole texts under a word-level BPE of the tokenizers library, with a bounded memory of their parts.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn. Words
of plain Latin letters are lower-cased and split here by the tokenizer's own pattern, and their parts go to the library's BPE model;
any other word goes through the library's whole chain.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from sightline.llm.words import Memory, gathered, numbered

# fixed values: the pre-tokenizer's pattern of the vocabulary
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose lower case and composition do not depend on anything around them.
PLAIN = re.compile("[!-~¡-įı-ſ]*")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBpe:
    """Ids of words as little-endian uint32 bytes, and of whole columns of texts."""

    _open: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
        self.memory = Memory()  # of parts, and of words that take the whole chain; other words are put together from their parts

    @classmethod
    def at(cls, path: str) -> WordBpe:
        """One for each worker and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _part(self, part: str) -> bytes:
        found = self.memory.new.get(part) or self.memory.get([part])[0]
        if found is None:
            shown = part.encode().decode("latin1").translate(self.alphabet)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            self.memory.put(part, found)
        return found

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            if word.isalpha():
                return self._part(word.lower())
            if word[:-1].isalpha() and word[-1] in ".,":
                return self._part(word[:-1].lower()) + self._part(word[-1])
            return b"".join(map(self._part, PARTS.findall(word.lower())))
        ids = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        self.memory.put(word, ids)
        return ids

    def _remembered(self, found: list[str]) -> list[bytes]:
        out = self.memory.get(found)
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._word(found[i]) if found[i] else b""
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self._remembered(text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        codes, distinct = numbered(lists.flatten())
        return gathered(self._remembered(distinct), codes, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
