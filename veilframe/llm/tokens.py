"""Token ids of whole texts as the tokenizers library gives them, remembered by word.

For a vocabulary whose pre-tokenizer drops white space (word_bpe_49k.json), a text's ids are the ids of
its white-space-separated chunks one after another. A chunk of plain Latin characters is cut by the
file's own pattern and each piece goes to the library's model; any other chunk (special strings,
other scripts, control characters) goes to the whole library. All other files take whole texts.
"""

from __future__ import annotations

import json
import sys
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from veilframe.llm.common import CACHE_ENTRIES

#: The default vocabulary; every operator takes the path as a parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Visible ASCII, and Latin letters that are their own composed form and lower-case to one character.
_PLAIN = regex.compile("[!-~À-įı-ɏ]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)]


class TextEncoder:
    """ids(text): the text's token ids as little-endian unsigned 32-bit integers, without special additions."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        model, steps = self.file["model"], (self.file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        cut = [s for s in steps if s["type"] == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
        drops = cut and model["type"] == "BPE" and r"\s" in cut[0]["pattern"].get("Regex", "")
        plain_added = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in self.file.get("added_tokens", []))
        self.by_chunk = bool(drops and plain_added and model.get("end_of_word_suffix"))
        self.chunks: dict[bytes, bytes] = _Remembered(self._chunk)
        self.pieces: dict[str, bytes] = _Remembered(self._piece)
        if self.by_chunk:
            self.pattern = regex.compile(cut[0]["pattern"]["Regex"])
            self.alphabet = byte_alphabet()
            # words and words with one mark need no pattern where the pattern keeps letters and marks apart
            self.marks = frozenset(c for c in b",.;:!?" if self.pattern.findall(f"ab{chr(c)}") == ["ab", chr(c)])
            self.starts = tuple({t["content"][:2] for t in self.file.get("added_tokens", [])})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        # visible ASCII stands for itself
        symbols = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        return _packed([t.id for t in self.model.tokenize(symbols)])

    def pieces_of(self, chunk: bytes) -> list[str] | None:
        """The pre-tokens of a plain chunk; None where only the whole library may cut it."""
        text = chunk.decode()
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.starts):
            return None
        if self.marks and text.isalpha():
            return [text.lower()]
        return self.pattern.findall(text.lower())

    def _chunk(self, chunk: bytes) -> bytes:
        if self.marks:
            if chunk.isalpha():
                return self.pieces[chunk.decode().lower()]
            if chunk[-1] in self.marks and chunk[:-1].isalpha():
                return self.pieces[chunk[:-1].decode().lower()] + self.pieces[chr(chunk[-1])]
        pieces = self.pieces_of(chunk)
        if pieces is None:
            return self._whole(chunk.decode())
        return b"".join([self.pieces[p] for p in pieces])

    def ids(self, data: bytes | None) -> bytes:
        if not data:
            return b""
        if self.by_chunk:
            return b"".join(map(self.chunks.__getitem__, data.split()))
        return self._whole(data.decode())


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Remembered(dict):
    """Results in two generations: when the younger is full it becomes the older, so frequent keys stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    return TextEncoder(path)
