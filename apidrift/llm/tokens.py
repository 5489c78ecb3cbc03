"""Token ids of whole texts with a public byte-level BPE, inside tasks.

Invented and natural words repeat a lot, so a text is cut at single spaces
and line ends, and the ids of each distinct piece are kept in a bounded
table of the Python worker.  A cut is only made where the tokenizer's own
rule starts a new word in any case: at one space or one line end between
two characters that aren't white space.  Any other text (runs of white
space, tabs, white space at an end, a special token's string) goes through
the tokenizer whole.

Ids of new pieces come from the same vocabulary read as ranks, which is
several times faster than the tokenizer; tests hold both against each other.
"""

from __future__ import annotations

import base64
import os

import numpy as np

PIECES_KEPT = 500_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Irregular(Exception):
    pass


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers; ``lead`` goes before each."""

    def __init__(self, lead: str, encode):
        super().__init__()
        self.lead, self.encode = lead, encode

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        if len(self) >= PIECES_KEPT:
            self.clear()
        ids = np.asarray(self.encode(self.lead + piece), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: token ids as bytes of little-endian unsigned 32-bit integers."""

    _kept: dict[tuple[str, str], "Encoder"] = {}

    @classmethod
    def of(cls, tokenizer: str, ranks: str) -> "Encoder":
        """One encoder for each pair of files and worker process."""
        key = (tokenizer, ranks)
        if key not in cls._kept:
            cls._kept[key] = cls(tokenizer, ranks)
        return cls._kept[key]

    def __init__(self, tokenizer: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=table, special_tokens={})
        self.first = _Pieces("", fast.encode_ordinary)
        self.inner = _Pieces(" ", fast.encode_ordinary)
        self.line_end = np.asarray(fast.encode_ordinary("\n"), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            try:
                out = []
                first, inner = self.first.__getitem__, self.inner.__getitem__
                for line in text.split("\n"):
                    words = line.split(" ")
                    out.append(self.line_end)
                    out.append(first(words[0]))
                    out.extend(map(inner, words[1:]))
                return b"".join(out[1:])
            except _Irregular:
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
