"""The archive format's byte codecs, without Spark.

Encoders and decoders of integers, page-number lists, interval lists, diffs and
headers.  Decoders take a ``Reader``.  Malformed input raises ``FormatError``.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
from dataclasses import dataclass

#: Fixed values of the format.
MAGIC = "MBCR"
VERSION = (2, 1)
INNER = ("", "gzip", "bzip2", "7zip")
LEFT_BITS, PATCH_PAGE = 29, 4096
#: Bits of the dictionary of each xz preset.
XZ_BITS = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)
METHOD = re.compile(r"(?:(interdedup)(nointra)?(delta)?|(intradedup))(gzip|bzip2|7zip)?|(gzip|bzip2|7zip)")


class FormatError(ValueError):
    pass


class Reader:
    """Bytes with a place; reading past the end raises."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise FormatError("unexpected end")
        self.at += n
        return self.raw[self.at - n : self.at]

    def little(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def text(self) -> str:
        end = self.raw.find(b"\0", self.at)
        if end < 0:
            raise FormatError("a string has no end")
        return self.take(end + 1 - self.at)[:-1].decode("utf-8", "surrogateescape")

    @property
    def over(self) -> bool:
        return self.at >= len(self.raw)


def text(value: str) -> bytes:
    return value.encode("utf-8", "surrogateescape") + b"\0"


def page_numbers(numbers: list[int]) -> bytes:
    """Ascending numbers as gaps: one byte with the top bit set below 128, else four bytes, high first."""
    out, before = [len(numbers).to_bytes(4, "little")], -1
    for k, n in enumerate(numbers):
        gap = n if k == 0 else n - before - 1
        if gap < 0 or gap >= 1 << 31:
            raise FormatError(f"page number {n} after {before}")
        out.append(bytes([gap | 0x80]) if gap < 128 else gap.to_bytes(4, "big"))
        before = n
    return b"".join(out)


def read_page_numbers(r: Reader) -> list[int]:
    out: list[int] = []
    for _ in range(r.little(4)):
        head = r.take(1)[0]
        gap = head & 0x7F if head & 0x80 else int.from_bytes(bytes([head]) + r.take(3), "big")
        out.append(gap + out[-1] + 1 if out else gap)
    return out


def interval(left: int, right: int, last: bool) -> bytes:
    if not 0 <= left < 1 << LEFT_BITS or right < left:
        raise FormatError(f"interval {left}..{right}")
    span = right - left
    width = next(k for k, n in enumerate((0, 1, 2, 4)) if span < 1 << 8 * n or n == 4)
    n = (0, 1, 2, 4)[width]
    return (last << 31 | width << LEFT_BITS | left).to_bytes(4, "little") + span.to_bytes(n, "little")


def interval_list(intervals: list[tuple[int, int]]) -> bytes:
    return b"".join(interval(a, b, k == len(intervals) - 1) for k, (a, b) in enumerate(intervals))


def read_interval_list(r: Reader) -> list[tuple[int, int]]:
    out = []
    while True:
        word = r.little(4)
        left = word & (1 << LEFT_BITS) - 1
        out.append((left, left + r.little((0, 1, 2, 4)[word >> LEFT_BITS & 3])))
        if word >> 31:
            return out


def patch_header(rel_off: int, length: int, short_off_limit: int = 256) -> bytes:
    if rel_off >= PATCH_PAGE or not 1 <= length <= 2048:
        raise FormatError(f"patch of {length} at {rel_off}")
    if length <= 128 and rel_off < short_off_limit:
        return bytes((length - 1, rel_off))
    return (0x800000 | (length - 1) << 12 | rel_off).to_bytes(3, "big")


def diff(patches: list[tuple[int, bytes]], short_off_limit: int = 256) -> bytes:
    """Patches as (relative offset, bytes)."""
    return len(patches).to_bytes(2, "little") + b"".join(patch_header(off, len(b), short_off_limit) + b for off, b in patches)


def read_diff(r: Reader) -> list[tuple[int, bytes]]:
    out = []
    for _ in range(r.little(2)):
        head = r.take(2)
        if head[0] & 0x80:
            word = int.from_bytes(head + r.take(1), "big")
            off, n = word & 0xFFF, (word >> 12 & 0x7FF) + 1
        else:
            off, n = head[1], head[0] + 1
        out.append((off, r.take(n)))
    return out


def apply_diff(page: bytes, patches: list[tuple[int, bytes]]) -> bytes:
    out, at = bytearray(page), 0
    for off, b in patches:
        at += off
        if at + len(b) > len(out):
            raise FormatError("a patch reaches past its page")
        out[at : at + len(b)] = b
        at += len(b)
    return bytes(out)


@dataclass(frozen=True)
class Method:
    """What an archive's method name says."""

    kind: str  # interdedup, intradedup or whole
    intra: bool = True
    delta: bool = False
    inner: str = ""

    def __str__(self) -> str:
        if self.inner not in INNER:
            raise FormatError(f"codec {self.inner!r}")
        head = {"interdedup": "interdedup" + "nointra" * (not self.intra) + "delta" * self.delta, "intradedup": "intradedup", "whole": ""}[self.kind]
        return head + self.inner

    @classmethod
    def parse(cls, name: str) -> Method:
        m = METHOD.fullmatch(name)
        if not m:
            raise FormatError(f"method {name!r}")
        if m[6]:
            return cls("whole", inner=m[6])
        return cls(m[1] or m[4], intra=not m[2], delta=bool(m[3]), inner=m[5] or "")


METHODS = [str(Method("interdedup", i, d, c)) for i in (True, False) for d in (False, True) for c in INNER] + [str(Method("intradedup", inner=c)) for c in INNER] + [*INNER[1:]]


def header(method: str, pagesize: int, size: int, version: tuple[int, int] = VERSION) -> bytes:
    return text(MAGIC) + text(method) + b"".join(n.to_bytes(w, "little") for n, w in ((version[0], 2), (version[1], 2), (pagesize, 4), (size, 8)))


def read_header(r: Reader) -> dict:
    """Any version is accepted."""
    if r.text() != MAGIC:
        raise FormatError("not an archive")
    return {"method": r.text(), "major": r.little(2), "minor": r.little(2), "pagesize": r.little(4), "uncompressed_size": r.little(8)}


def compress(raw: bytes, codec: str, level: int = 9) -> bytes:
    if codec == "gzip":
        return gzip.compress(raw, level, mtime=0)
    if codec == "bzip2":
        return bz2.compress(raw, level)
    if codec == "7zip":
        # A dictionary as long as the input reaches all of it; an encoder clears tables of the dictionary's size first.
        bits = min(XZ_BITS[level], max(12, len(raw).bit_length()))
        return lzma.compress(raw, lzma.FORMAT_XZ, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": 1 << bits}])
    if codec == "":
        return raw
    raise FormatError(f"codec {codec!r}")


def decompress(raw: bytes, codec: str) -> bytes:
    if codec not in INNER:
        raise FormatError(f"codec {codec!r}")
    return {"": lambda x: x, "gzip": gzip.decompress, "bzip2": bz2.decompress, "7zip": lambda x: lzma.decompress(x, lzma.FORMAT_AUTO)}[codec](raw)


def opener(path: str, codec: str, level: int = 9):
    """A file object that compresses what is written, piece by piece."""
    if codec == "gzip":
        return gzip.GzipFile(filename="", mode="ab", compresslevel=level, fileobj=open(path, "ab"), mtime=0)
    if codec == "bzip2":
        return bz2.BZ2File(open(path, "ab"), "w", compresslevel=level)
    if codec == "7zip":
        return lzma.LZMAFile(open(path, "ab"), "w", format=lzma.FORMAT_XZ, preset=level)
    if codec == "":
        return open(path, "ab")
    raise FormatError(f"codec {codec!r}")
