"""Words of letters, digits and non-ASCII characters, A-Z in lower case, cut in Python from whole texts."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text cut into words at a time, about: a long text's words needn't stand in memory together.
PIECE = 4 << 20
#: A-Z to a-z, other ASCII but digits and letters to a space; UTF-8 has no ASCII byte within a longer character.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """A text's words in order, some megabytes at a time; never cuts a word."""
    raw = raw.translate(_TABLE)
    at = 0
    while len(raw) - at > size:
        end = raw.find(b" ", at + size)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield (raw[at:] if at else raw).split()
