"""Terms of texts, split on bytes: A-Z lower-cased, bytes that no term has turned into blanks, then split.

In UTF-8 the bytes of a character beyond ASCII are all 0x80 or more, so classes of ASCII characters can be told by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once; a longer text is cut at a byte that no term has.
PIECE = 1 << 20


def byte_table(inside) -> bytes:
    """For bytes.translate: a blank for each ASCII byte that inside() refuses, small letters for A-Z."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or inside(b) else 32 for b in range(256))


#: Letters, figures and all that is beyond ASCII.
WORDY = byte_table(lambda b: chr(b).isalnum())
#: Letters and all that is beyond ASCII.
LETTERS = byte_table(lambda b: chr(b).isalpha())


def terms(text: str | None, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, one for each piece of it; none for a text without terms or a null."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(table)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        if found := data[at:end].split():
            yield found
        at = end
