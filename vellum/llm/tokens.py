"""Token ids of whole texts by the tokenizers library, with the library's answers for words kept in the worker.

Where the vocabulary file makes all white space one, lower-cases, and keeps the matches of a pattern as byte-level pieces, a
text's ids are those of its chunks between white space, one after another. Frequent chunks and pieces are asked for once
a worker; the stores are bounded. The pattern is read from the file, and files of any other layout are asked for whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from .common import held

VOCABULARY = "word_bpe_49k.json"
CHUNKS_KEPT, PIECES_KEPT = 250_000, 350_000
#: Python splits at these, the vocabulary does not
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: not stable under normalization, or in another case in another way, or part of a special token
NOT_PLAIN = regex.compile("[^\x21-\xff]|[\x7f-\xa0]|<\\|")


#: a file of the layout that can be asked chunk by chunk, the pattern aside
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def piece_pattern(layout: dict) -> str | None:
    """The pattern of pieces in a tokenizer's JSON, or None where chunks between white space cannot be asked for one by one."""
    steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if (layout.get("normalizer") or {}).get("normalizers") != NORMALIZERS or layout.get("post_processor") or len(steps) != 2 or steps[1] != BYTES:
        return None
    split = steps[0]
    found = split.get("pattern", {}).get("Regex") if (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True) else None
    return found if found and regex.search(found, " \t\n") is None else None


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids, as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.model = self.whole.model
        parts = {"normalizer": self.whole.normalizer, "pre_tokenizer": self.whole.pre_tokenizer, "post_processor": self.whole.post_processor}
        # the parts alone: the whole file's JSON, vocabulary included, would take far more memory
        found = piece_pattern({k: p and json.loads(p.__getstate__()) for k, p in parts.items()})
        self.pattern = found and regex.compile(found)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = byte_letters()

    def _all(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        got = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
        if len(self.pieces) < PIECES_KEPT:
            self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if NOT_PLAIN.search(chunk):
            got = self._all(chunk)
        else:
            known = self.pieces.get
            got = b"".join([known(p) or self._piece(p) for p in self.pattern.findall(chunk.lower())])
        if len(self.chunks) < CHUNKS_KEPT:
            self.chunks[chunk] = got
        return got

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pattern is None or SEPARATORS.search(text):
            return self._all(text)
        words = text.split()
        parts = list(map(self.chunks.get, words))
        if None in parts:
            known, new = self.chunks.get, self._chunk
            parts = [known(w) or new(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary: a path, or the name of a file of public_tokenizers."""

    def make() -> Encoder:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        return Encoder(path)

    return held(("vocabulary", vocabulary), make)
