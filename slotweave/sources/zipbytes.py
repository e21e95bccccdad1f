"""Packages as bytes: the central directory, members' bytes as they lie there, and a copy with some members replaced.

Members that stay are copied as they lie in the package, compressed bytes and all, so nothing of them can change.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

_END = struct.Struct("<4s4H2LH")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
#: Flag bits: encrypted; sizes stand behind the data; names are UTF-8.
LOCKED, TRAILED, UTF8 = 1, 8, 0x800


class BadPackage(ValueError):
    """The bytes are no package that can be read; the message is its problem code."""


@dataclass
class Member:
    """An entry of the central directory: its fields, and the record itself."""

    path: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    at: int
    record: bytes


def end_of_directory(tail: bytes) -> tuple[int, int, int]:
    """(entries, bytes of the directory, its place) from the last bytes of a package."""
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or at + _END.size > len(tail):
        raise BadPackage("BAD_ZIP")
    _, _, _, _, n, size, place, _ = _END.unpack_from(tail, at)
    if place == 0xFFFFFFFF or n == 0xFFFF:
        raise BadPackage("TOO_LARGE")
    return n, size, place


def members(directory: bytes, n: int) -> list[Member]:
    out, at = [], 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise BadPackage("BAD_ZIP")
        _, _, _, flags, method, _, _, crc, packed, size, name, extra, comment, _, _, _, place = _CENTRAL.unpack_from(directory, at)
        end = at + _CENTRAL.size + name + extra + comment
        path = directory[at + _CENTRAL.size : at + _CENTRAL.size + name].decode("utf-8" if flags & UTF8 else "cp437")
        out.append(Member(path, flags, method, crc, packed, size, place, directory[at:end]))
        at = end
    return out


def data_place(local: bytes) -> int:
    """How far behind its start a local header's data begin."""
    if local[:4] != b"PK\x03\x04":
        raise BadPackage("BAD_ZIP")
    *_, name, extra = _LOCAL.unpack_from(local)
    return _LOCAL.size + name + extra


def content(member: Member, packed: bytes) -> bytes:
    """A member's content, inflated and checked."""
    if member.flags & LOCKED:
        raise BadPackage("ENCRYPTED")
    if member.method not in (0, 8):
        raise BadPackage("BAD_METHOD")
    inflate = zlib.decompressobj(-15)
    data = packed if member.method == 0 else inflate.decompress(packed, member.size + 1)
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise BadPackage("BAD_CRC")
    return data


class Package:
    """A package in memory."""

    def __init__(self, data: bytes):
        self.data = data
        n, size, place = end_of_directory(data[-(1 << 16) - _END.size :])
        self.comment = data[data.rfind(b"PK\x05\x06") + _END.size :]
        self.members = members(data[place : place + size], n)

    def packed(self, member: Member) -> tuple[bytes, bytes]:
        """(local header, compressed bytes) of a member."""
        begin = member.at + data_place(self.data[member.at :])
        return self.data[member.at : begin], self.data[begin : begin + member.packed]

    def content(self, path: str) -> bytes:
        member = next(m for m in self.members if m.path == path)
        return content(member, self.packed(member)[1])

    def rewritten(self, replaced: dict[str, bytes]) -> bytes:
        """The package with some members' contents replaced; order, names, times, attributes and comment stay."""
        out, directory = bytearray(), bytearray()
        for m in self.members:
            local, packed = self.packed(m)
            crc, size = m.crc, m.size
            if m.path in replaced:
                data = replaced[m.path]
                crc, size, packed = zlib.crc32(data), len(data), data
                if m.method == 8:
                    deflate = zlib.compressobj(wbits=-15)
                    packed = deflate.compress(data) + deflate.flush()
            flags = m.flags & ~TRAILED  # the sizes stand in front, so nothing follows the data
            head, record = bytearray(local), bytearray(m.record)
            struct.pack_into("<H", head, 6, flags)
            struct.pack_into("<3L", head, 14, crc, len(packed), size)
            struct.pack_into("<H", record, 8, flags)
            struct.pack_into("<3L", record, 16, crc, len(packed), size)
            struct.pack_into("<L", record, 42, len(out))
            out += head + packed
            directory += record
        end = _END.pack(b"PK\x05\x06", 0, 0, len(self.members), len(self.members), len(directory), len(out), len(self.comment))
        return bytes(out + directory + end + self.comment)
