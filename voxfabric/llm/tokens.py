"""Token ids by a public tokenizer, inside tasks."""

from __future__ import annotations

import codecs
import functools
import json
import os
import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: Pieces of a byte-level BPE before merging; white space as Unicode defines it.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII and of the letters from U+00C0 to U+024F, spelt out, which is twice as fast.
_LETTER, _BLANK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\t-\r "
_LATIN_PIECES = rf" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
_beyond_latin = re.compile("[^\0-\x7f\u00c0-\u024f]").search


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    out, spare = [], iter(range(256, 512))
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out.append(chr(b if printable else next(spare)))
    return "".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """texts -> token ids as little-endian bytes, 2 or 4 to an id.

    A byte-level BPE never merges across pieces, so each distinct piece is
    encoded once and remembered, up to max_pieces of at most 64 characters;
    then the memory starts anew. Texts that hold a string of an added token,
    such as "<|endoftext|>", are encoded whole, as are all texts by other
    tokenizers.
    """

    def __init__(self, path: str, max_pieces: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_piece = plain and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.split_any = regex.compile(_PIECES).findall
        self.split_latin = re.compile(_LATIN_PIECES).findall
        self.characters = _byte_characters()

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        merge, spelt = self.tokenizer.model.tokenize, codecs.charmap_decode
        return [np.array([t.id for t in merge(spelt(p.encode(), "strict", self.characters)[0])], self.dtype).tobytes() for p in pieces]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._ids(texts)
        out = []
        for text in texts:
            if any(a in text for a in self.added):
                out += self._ids([text])
                continue
            pieces = (self.split_any if _beyond_latin(text) else self.split_latin)(text)
            known = self.known
            try:
                out.append(b"".join(map(known.__getitem__, pieces)))
            except KeyError:
                new = list({p for p in pieces if p not in known})
                ids = dict(zip(new, self._piece_ids(new)))
                if len(known) + len(ids) > self.max_pieces:
                    known.clear()
                    new = list({p for p in pieces if p not in ids})
                    ids |= zip(new, self._piece_ids(new))
                known.update(x for x in ids.items() if len(x[0]) <= 64)
                out.append(b"".join([known.get(p) or ids[p] for p in pieces]))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
