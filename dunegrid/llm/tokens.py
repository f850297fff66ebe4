"""Whole-text encoding with a ``tokenizers`` file, with a cache of pieces.

Before any merge, both tokenizer kinds in use cut a text into pieces by a
published pattern (contractions, letter runs, digits, mark runs, white space),
and a text's ids are its pieces' ids in a row, so a worker asks the file's
model for each distinct piece once.  The pattern is applied here to texts of
ASCII and Latin-1 letters only, where every library agrees on what a letter or
a space is; any other text, and any text with a special token's ``<|``, is
encoded whole by the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r -~{_L}]*")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pattern of byte-level files: white space stays in the tokens.
#: (Letters come first for speed; no two of these can start alike but the marks.)
_KEEP_SPACE = re.compile(rf" ?[{_L}]+|{_CONTRACTIONS}| ?[^\s{_L}0-9]+| ?[0-9]+|\s+(?!\S)|\s+")
#: The pattern of lower-casing files: white space is dropped, digits stand alone.
_DROP_SPACE = re.compile(rf"[{_L}]+|{_CONTRACTIONS}|[^\s{_L}0-9]+|[0-9]")
#: Pieces kept per worker process (about 200 bytes each), in two generations: a
#: full young generation becomes the old one, from which pieces in use return.
CACHE_PIECES = 800_000
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 48


def _byte_chars() -> dict[int, str]:
    """The published byte-to-character rule of byte-level BPE: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return out


class _Pieces(dict):
    """Ids of pieces; a piece not held yet is looked up by the file's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.chars = _byte_chars()
        self.space = self.chars[32]
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self) > CACHE_PIECES // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():
                chars = piece.replace(" ", self.space)
            else:
                chars = piece.encode().decode("latin-1").translate(self.chars)
            ids = array("I", [t.id for t in self.tokenize(chars)]).tobytes()
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


def _plain(text: str) -> bool:
    """Whether the patterns above apply (see the module's docstring)."""
    if "<|" in text:
        return False
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return _PLAIN.fullmatch(text) is not None


class WordEncoder:
    """``encode(texts) -> list[bytes]``: each text's ids as little-endian uint32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        kind = json.loads(self.full.to_str())
        pre = kind.get("pre_tokenizer") or {}
        parts = [p.get("type") for p in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.lower = parts == ["NFC", "Replace", "Lowercase"]
        self.byte_level = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        self.pieces = _DROP_SPACE if self.lower else _KEEP_SPACE
        self.cache = _Pieces(self.full.model)

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.lower or self.byte_level
        out = []
        for text in texts:
            if not known or not _plain(text):
                out.append(self._whole(text))
                continue
            self.cache.age()
            pieces = self.pieces.findall(text.lower() if self.lower else text)
            out.append(b"".join(map(self.cache.__getitem__, pieces)))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per file and worker process; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
