"""Public tokenizers, loaded once a Python worker from files that every machine has; paths are parameters and nothing is trained.

A byte-level vocabulary is read from its `tokenizers` file and encoded by `tiktoken`, which gives the same ids (tests compare the two on every character)
in a quarter of the time.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Fixed value: how text is split before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: visible Latin-1 letters for themselves, the rest from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """A byte-level BPE vocabulary: ids of a text, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_of_letter()
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in content["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        size = 1 + max([*ranks.values(), *special.values()])
        self.pieces = [b""] * size
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens are those tokens."""
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special=self.special), dtype=np.uint32)

    def plain_ids(self, text: str) -> np.ndarray:
        """Ids of a text in which strings of special tokens are plain text."""
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)


class PieceVocabulary:
    """A piece vocabulary with byte fallback: ids of a text, and the bytes of every id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [
            bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def byte_vocabulary(path: str = BYTE_BPE) -> ByteVocabulary:
    return ByteVocabulary(path)


@cache
def piece_vocabulary(path: str = PIECE_BPE) -> PieceVocabulary:
    return PieceVocabulary(path)
