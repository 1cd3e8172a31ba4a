"""Stored members of a ZIP archive, found by its central directory and read by ranges.

``read`` is a function (offset, length) -> bytes, so an archive can lie in any store with range
reads; nothing is extracted, and no more is read than the directory and what is asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

Read = Callable[[int, int], bytes]

# Record signatures and fixed parts of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_EXTRA = 1


class Member(NamedTuple):
    name: str
    header: int
    size: int
    stored: bool


def _directory(read: Read, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory; of the ZIP64 one where fields are full."""
    tail_at = max(0, size - (22 + FULL16 + 20))
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP archive")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (length, offset):
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR:
            return offset, length, entries
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        record = read(end64, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def members(read: Read, size: int) -> list[Member]:
    """All members, in the directory's order."""
    offset, length, entries = _directory(read, size)
    data, at, found = read(offset, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n_name]
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == ZIP64_EXTRA:
                wide = iter(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4))
                whole = next(wide) if whole == FULL32 else whole
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + n :]
        text = name.decode("utf-8" if flags & 0x800 else "cp437")
        found.append(Member(text, header, packed, method == 0 and not flags & 1))
        at += 46 + n_name + n_extra + n_comment
    return found


def start_of(read: Read, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed or encrypted, so it has no ranges")
    header = read(member.header, 30)
    if header[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra
