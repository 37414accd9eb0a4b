"""SECS-II items: validate, decode, encode, print.

An item is a format byte (code and number of length bytes), one to three length
bytes, and data, big-endian.  Decoded items are `Item`s; text is ISO-8859-1,
which maps every byte to a character.
"""

from __future__ import annotations

import struct
from collections.abc import Generator, Sequence
from dataclasses import dataclass

import numpy as np

MAX_DEPTH = 64
#: Format code, struct letter and size by name; codes are octal in the standard.
FORMATS = {
    "L": (0o00, "", 0),
    "B": (0o10, "B", 1),
    "BOOLEAN": (0o11, "?", 1),
    "A": (0o20, "", 1),
    "J": (0o21, "", 1),
    "I8": (0o30, "q", 8),
    "I1": (0o31, "b", 1),
    "I2": (0o32, "h", 2),
    "I4": (0o34, "i", 4),
    "F8": (0o40, "d", 8),
    "F4": (0o44, "f", 4),
    "U8": (0o50, "Q", 8),
    "U1": (0o51, "B", 1),
    "U2": (0o52, "H", 2),
    "U4": (0o54, "I", 4),
}
NAMES = {code: name for name, (code, _, _) in FORMATS.items()}
UNSIGNED = ("U1", "U2", "U4", "U8")


class SecsError(ValueError):
    """code is a short name, offset the byte of the item at fault."""

    def __init__(self, code: str, offset: int = 0) -> None:
        super().__init__(f"{code} at {offset}")
        self.code, self.offset = code, offset


@dataclass(frozen=True)
class Item:
    """A list of items, a text, or a tuple of values."""

    format: str
    value: tuple | str | bytes

    def items(self, size: int | None = None) -> tuple[Item, ...]:
        if self.format != "L" or size is not None and len(self.value) != size:
            raise SecsError("unexpected_format")
        return self.value

    def text(self) -> str:
        if self.format not in ("A", "J"):
            raise SecsError("unexpected_format")
        return self.value

    def values(self, format: str) -> tuple | bytes:
        if self.format != format or format in ("L", "A", "J"):
            raise SecsError("unexpected_format")
        return self.value

    def scalar(self, format: str):
        v = self.values(format)
        if len(v) != 1:
            raise SecsError("not_scalar")
        return v[0]

    def unsigned(self) -> int:
        """The value of a U1, U2, U4 or U8 item of one value."""
        if self.format not in UNSIGNED:
            raise SecsError("unexpected_format")
        return self.scalar(self.format)

    def at(self, i: int) -> Item:
        children = self.items()
        if not 0 <= i < len(children):
            raise SecsError("out_of_range")
        return children[i]


#: (format, number of length bytes, size of a value) by format byte.
_HEADS = {code << 2 | n: (name, n, size) for name, (code, _, size) in FORMATS.items() for n in (1, 2, 3)}


def _item(data: bytes, at: int) -> tuple[str, int, int]:
    """Format, length and where the data starts, of the item at a place; values must be whole and all there, children needn't."""
    if at >= len(data):
        raise SecsError("truncated", at)
    head = _HEADS.get(data[at])
    if head is None:
        raise SecsError("unknown_format" if data[at] % 4 else "zero_length_bytes", at)
    name, n, size = head
    start = at + 1 + n
    length = int.from_bytes(data[at + 1 : start], "big")
    if start > len(data):
        raise SecsError("truncated", at)
    if size and length % size:
        raise SecsError("bad_array_length", at)
    if size and start + length > len(data):
        raise SecsError("truncated", at)
    return name, length, start


def _spans(data: bytes, at: int = 0, path: tuple[int, ...] = ()) -> Generator[tuple[tuple[int, ...], str, int, int], None, int]:
    """(path, format, length, where the data starts) of an item and of all below it, in order; returns where the item ends."""
    name, length, start = _item(data, at)
    if name == "L" and length and len(path) == MAX_DEPTH:
        raise SecsError("too_deep", at)
    yield path, name, length, start
    if name != "L":
        return start + length
    for i in range(length):
        start = yield from _spans(data, start, (*path, i))
    return start


def validate(data: bytes) -> int:
    """The length of the first item, or SecsError."""
    spans = _spans(data)
    while True:
        try:
            next(spans)
        except StopIteration as end:
            return end.value


def _values(name: str, raw: bytes):
    if name in ("A", "J"):
        return raw.decode("latin-1")
    if name == "B":
        return bytes(raw)
    if name == "BOOLEAN":
        return tuple(b != 0 for b in raw)
    _, letter, size = FORMATS[name]
    return struct.unpack(f">{len(raw) // size}{letter}", raw)


def decode_prefix(data: bytes, at: int = 0, depth: int = 0) -> tuple[Item, int]:
    """The item at a place, and where it ends."""
    name, length, start = _item(data, at)
    if name != "L":
        return Item(name, _values(name, data[start : start + length])), start + length
    if length and depth == MAX_DEPTH:
        raise SecsError("too_deep", at)
    children = []
    for _ in range(length):
        child, start = decode_prefix(data, start, depth + 1)
        children.append(child)
    return Item("L", tuple(children)), start


def decode(data: bytes) -> Item:
    """Exactly one item."""
    item, end = decode_prefix(data)
    if end != len(data):
        raise SecsError("trailing_bytes", end)
    return item


def encode(item: Item) -> bytes:
    """Canonical bytes: as few length bytes as will do."""
    code, letter, size = FORMATS[item.format]
    v = item.value
    if item.format == "L":
        body, length = b"".join(map(encode, v)), len(v)
    else:
        if item.format in ("A", "J"):
            body = v.encode("latin-1")
        elif item.format == "B":
            body = bytes(v)
        elif item.format == "BOOLEAN":
            body = bytes(map(bool, v))
        else:
            body = struct.pack(f">{len(v)}{letter}", *v)
        length = len(body)
    if length >= 1 << 24:
        raise SecsError("too_long")
    n = max(1, (length.bit_length() + 7) // 8)
    return bytes([code << 2 | n]) + length.to_bytes(n, "big") + body


def L(*items: Item) -> Item:
    return Item("L", tuple(items))


def A(text: str) -> Item:
    return Item("A", text)


def B(*values: int) -> Item:
    return Item("B", bytes(values))


def U(format: str, *values: int) -> Item:
    return Item(format, tuple(values))


def _text(value: str) -> str:
    """Printable runs in quotes, other bytes in hex."""
    parts: list[str] = []
    run = ""
    for ch in value:
        if " " <= ch <= "~" and ch != '"':
            run += ch
            continue
        if run:
            parts.append(f'"{run}"')
            run = ""
        parts.append(f"0x{ord(ch):02X}")
    return " ".join([*parts, *([f'"{run}"'] if run else [])])


def _number(v) -> str:
    """Whole numbers without a fraction, others as short as reads back."""
    return str(int(v)) if abs(v) < 1e16 and v == int(v) else str(v)


def to_sml(item: Item, indent: int = 0) -> str:
    pad = " " * indent
    if item.format == "L":
        if not item.value:
            return f"{pad}<L [0]>"
        inner = "\n".join(to_sml(x, indent + 2) for x in item.value)
        return f"{pad}<L [{len(item.value)}]\n{inner}\n{pad}>"
    if item.format in ("A", "J"):
        shown: Sequence[str] = [_text(item.value)] if item.value else []
    elif item.format == "B":
        shown = [f"0x{b:02X}" for b in item.value]
    elif item.format == "BOOLEAN":
        shown = ["T" if v else "F" for v in item.value]
    elif item.format == "F4":
        shown = [_number(np.float32(v)) for v in item.value]
    else:
        shown = [_number(v) for v in item.value]
    return pad + "<" + " ".join([item.format, *shown]) + ">"


def nodes(data: bytes) -> list[tuple[list[int], str, int, bytes]]:
    """(path, format, length, data) of every item: the tree as rows."""
    return [(list(path), name, length, b"" if name == "L" else data[start : start + length]) for path, name, length, start in _spans(data)]
