"""The LZ codec that browsers' share links use: texts as UTF-16 units, a growing dictionary, codes of growing width.

Codes begin with 2 bits. 0 announces a new unit of 8 bits, 1 one of 16 bits, 2 the end; from 3 on they name dictionary entries, each of
which is the entry before and the first unit of the one after. When as many entries have been made as codes of a width can
tell apart, codes get a bit more. Bits go lowest first; six of them, the first one highest, are a character of the alphabet.
"""

from __future__ import annotations

#: The alphabets for links and for base64.
LINK = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-$"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
NEW_8, NEW_16, END, FIRST = 0, 1, 2, 3
#: The bits that characters of an alphabet stand for.
SIXES = [f"{k:06b}" for k in range(64)]


class _Width:
    """The width of codes; ``left`` entries can still be made before it grows."""

    def __init__(self, bits: int, left: int):
        self.bits, self.left = bits, left

    def made(self) -> None:
        self.left -= 1
        if not self.left:
            self.left, self.bits = 1 << self.bits, self.bits + 1


def _units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [a | b << 8 for a, b in zip(raw[::2], raw[1::2])]


def compress(text: str, alphabet: str = LINK) -> str:
    """The text as characters of the alphabet. The empty text is one code, the end."""
    bits: list[str] = []  # of each code, lowest first

    def put(value: int, width: int) -> None:
        bits.append(f"{value:0{width}b}"[::-1])

    known: dict[tuple[int, int], int] = {}  # entry and unit after it: the longer entry
    single: dict[int, int] = {}
    fresh: set[int] = set()
    width, size = _Width(2, 2), FIRST
    now, unit = -1, -1  # the entry matched so far, and its unit if it is a single one

    def emit() -> None:
        if now in fresh:
            put(NEW_8 if unit < 256 else NEW_16, width.bits)
            put(unit, 8 if unit < 256 else 16)
            fresh.discard(now)
            width.made()
        else:
            put(now, width.bits)
        width.made()

    for c in _units(text):
        if c not in single:
            single[c] = size
            fresh.add(size)
            size += 1
        if now < 0:
            now = unit = -1
        longer = single[c] if now < 0 else known.get((now, c))
        if longer is None:
            emit()
            known[now, c] = size
            size += 1
            now, unit = single[c], c
        else:
            now, unit = longer, c if now < 0 else -1
    if now >= 0:
        emit()
    put(END, width.bits)
    made = "".join(bits)
    made += "0" * (6 - len(made) % 6)  # at least one bit of padding, as others write it
    character = dict(zip(SIXES, alphabet))
    return "".join([character[made[k : k + 6]] for k in range(0, len(made), 6)])


def decompress(packed: str, most: int, alphabet: str = LINK) -> str:
    """The text of ``compress``; ValueError for anything else, or if it has more than ``most`` UTF-16 units. Entries are places in
    what has been read, so memory is bounded by the two."""
    six = dict(zip(alphabet, SIXES))
    try:
        source = "".join([six[c] for c in packed.rstrip(alphabet[64])])
    except KeyError as e:
        raise ValueError("a character is not in the alphabet") from e
    at = 0

    def take(width: int) -> int:
        nonlocal at
        if at + width > len(source):
            raise ValueError("the text is cut off")
        at += width
        return int(source[at - width : at][::-1], 2)

    text: list[int] = []
    entries: list[tuple[int, int] | int] = [0, 0, 0]  # a place and a length in ``text``, or a unit
    width = _Width(2, 1)
    before: tuple[int, int] | None = None
    while True:
        code = take(width.bits)
        if code == END:
            return b"".join(u.to_bytes(2, "little") for u in text).decode("utf-16-le", "surrogatepass")
        if code in (NEW_8, NEW_16):
            entries.append(take(8 if code == NEW_8 else 16))
            code = len(entries) - 1
            width.made()
        start = len(text)
        if code < len(entries):
            entry = entries[code]
            text.extend([entry] if isinstance(entry, int) else text[entry[0] : entry[0] + entry[1]])
        elif code == len(entries) and before:
            text.extend([*text[before[0] : before[0] + before[1]], text[before[0]]])
        else:
            raise ValueError("a code names no entry")
        if len(text) > most:
            raise ValueError("the text is too long")
        if before:
            entries.append((before[0], before[1] + 1))
            width.made()
        before = (start, len(text) - start)
