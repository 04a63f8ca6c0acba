"""Token ids by the tokenizers library, remembered by piece.

A byte-pair tokenizer works on each pre-token alone, so its ids for a text are those of the pre-tokens in turn. ``Encoder`` cuts texts at spaces,
remembers the ids of the chunks and of the pre-tokens in them (both caches are bounded; what
doesn't fit is encoded each time), and asks the library's model for pre-tokens it hasn't seen. Texts for which cutting at spaces could
change the result go to the library whole, as do all texts of a tokenizer whose set-up isn't one of the two known here. The tests
hold the ids against the library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
MAX_CHUNKS, MAX_PIECES = 250_000, 400_000
_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters on whose classes, case and composition all libraries agree: up to Latin Extended-B, and common punctuation.
_KNOWN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]*")
#: A space after white space and before more, or at the end: white space runs across the cut.
_UNSAFE_SPACE = re.compile(r"\s (?!\S)")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        pre, norm = setup.get("pre_tokenizer") or {}, setup.get("normalizer") or {}
        steps = [x["type"] for x in norm.get("normalizers", [])]
        inner = pre.get("pretokenizers", [])
        self.special = [t["content"] for t in setup.get("added_tokens", [])]
        plain_bpe = setup["model"]["type"] == "BPE" and not setup["model"].get("dropout") and not setup.get("post_processor") and not setup.get("truncation") and not setup.get("padding")
        self.kind = ""
        if plain_bpe and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind, self.split = "byte", regex.compile(_GPT2).findall
        elif plain_bpe and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in inner] == ["Split", "ByteLevel"] and inner[0]["pattern"].get("Regex") == _WORD and inner[0]["invert"] and inner[0]["behavior"] == "Removed" and not inner[1]["use_regex"] and not inner[1]["add_prefix_space"]:
            self.kind, self.split = "word", regex.compile(_WORD).findall
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(letters)], self.dtype).tobytes()
        if len(self.pieces) < MAX_PIECES:
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        text = unicodedata.normalize("NFC", chunk).lower() if self.kind == "word" else chunk
        get = self.pieces.get
        ids = b"".join([get(p) or self._piece(p) for p in self.split(text)])
        if len(self.chunks) < MAX_CHUNKS and len(chunk) < 64:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian numbers of ``dtype``, without special tokens added; none for a null text."""
        if not text:
            return b""
        if not self.kind or not _KNOWN.fullmatch(text) or any(s in text for s in self.special) or (self.kind == "byte" and ("  " in text or _UNSAFE_SPACE.search(text))):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        get, make = self.chunks.get, self._chunk
        if self.kind == "byte":  # a chunk starts at its space
            first, *rest = text.split(" ")
            keys = [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]
        else:
            keys = text.split(" ")
        parts = list(map(get, keys))
        if None in parts:
            parts = [make(k) if p is None else p for k, p in zip(keys, parts, strict=True)]
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file, so that its caches last over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
