"""Token ids of texts from memoised encodings of their space-delimited chunks.

Byte-level BPE splits a text into pre-tokens by a pattern in which a single space before a non-space always opens a new
pre-token. A text without awkward runs of white space therefore encodes to the concatenation of its chunks' encodings,
each chunk with its leading space, so each distinct chunk is encoded once for a worker and looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

#: White space other than the space itself, as the pattern's \s has it.
_OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_AWKWARD = ["  ", *(c + " " for c in _OTHER_SPACE if ord(c) < 128)]
_AWKWARD = ["  ", *(c + " " for c in _OTHER_SPACE)]


class ChunkMemo(dict):
    """key -> encode(prefix + key); at `limit` entries it starts anew, which bounds memory and changes no result."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 500_000, prefix: str = ""):
        super().__init__()
        self.encode, self.limit, self.prefix = encode, limit, prefix

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[key] = self.encode(self.prefix + key)
        return out


def encode_by_chunks(text: str, chunks: ChunkMemo) -> bytes:
    """The encoding of a whole text; chunks has the prefix " "."""
    if not text:
        return b""
    if any(x in text for x in (_ASCII_AWKWARD if text.isascii() else _AWKWARD)):
        return chunks.encode(text)
    first, *rest = text.split(" ")
    return (chunks.encode(first) if first else b"") + b"".join(map(chunks.__getitem__, rest))
