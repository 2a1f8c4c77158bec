"""Token ids of whole texts by the tokenizers library, a piece at a time.

A byte-level tokenizer merges only inside the pieces that its pattern cuts, so the ids of a text are
the ids of its pieces in order. The library encodes each piece once for as long as a bounded cache
keeps it. Special tokens written out in a text get their own ids, as is the library's default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .pretokens import PieceCache, in_blocks, split_flat


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
        #: Whether the file is of the kind that can be encoded by pieces; others go to the library text by text.
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain and len(added) <= 1
        self._special = added[0]["content"] if added else None
        self._special_ids = np.array([a["id"] for a in added[:1]], dtype="<u4").tobytes()
        top = max(self._tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        #: The smallest unsigned type that holds all ids.
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self._model = self._tokenizer.model
        self._cache = PieceCache(self._merge)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each by the library's model on the characters that stand for its bytes."""
        tokenize, table = self._model.tokenize, _byte_characters()
        return [np.array([t.id for t in tokenize(p.encode().decode("latin-1").translate(table))], dtype="<u4").tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for block in in_blocks(texts):
            if not self.by_pieces:
                yield from self._encode(block)
                continue
            if self._special and any(self._special in t for t in block):
                stretches = [t.split(self._special) for t in block]
            else:
                stretches = [[t] for t in block]
            pieces, counts = split_flat([s for parts in stretches for s in parts])
            values = self._cache.values(pieces)
            at = k = 0
            for parts in stretches:
                ids = []
                for _ in parts:
                    ids.append(b"".join(values[at : at + counts[k]]))
                    at += counts[k]
                    k += 1
                yield self._special_ids.join(ids)


@lru_cache(1)
def _byte_characters() -> str:
    """Byte-level tokenizers write each byte as a printable character: itself, or one from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


@lru_cache(4)
def tokenizer(path: str) -> TokenIds:
    """One for each worker process and file."""
    return TokenIds(path)
