from __future__ import annotations

import lzma
import random

import pytest
from hypothesis import given, settings, strategies as st

from pagefold.functions import codec, small
from pagefold.functions.codec import FormatError, Method, Reader
from pagefold.operators.diff import find_patches

INTERVALS = [
    ((5, 5, False), "05000000"), ((5, 5, True), "05000080"), ((1, 3, True), "010000a002"), ((0, 255, False), "00000020ff"), ((0, 256, False), "000000400001"),
    ((7, 65542, True), "070000c0ffff"), ((7, 65543, True), "070000e000000100"), ((2**29 - 1, 2**29 - 1, True), "ffffff9f"),
]
NUMBERS = [([], "00000000"), ([0], "0100000080"), ([127], "01000000ff"), ([128], "0100000000000080"), ([3, 4, 200], "030000008380000000c3"), ([0, 128], "0200000080ff"), ([0, 129], "020000008000000080")]


@pytest.mark.parametrize("given_, code", INTERVALS)
def test_interval(given_, code):
    assert codec.interval(*given_).hex() == code


@pytest.mark.parametrize("given_, code", NUMBERS)
def test_page_numbers(given_, code):
    assert codec.page_numbers(given_).hex() == code
    assert codec.read_page_numbers(Reader(bytes.fromhex(code))) == given_


def _changed(*places, values=None):
    page = bytearray(4096)
    for k, p in enumerate(places):
        page[p] = (values or [1] * len(places))[k]
    return bytes(page)


def _diff(page, limit=256):
    return codec.diff([(off, b) for _, off, _, b in find_patches(page, bytes(4096))], limit)


@pytest.mark.parametrize(
    "page, narrow, wide",
    [
        (_changed(0), "0100000001", "0100000001"),
        (_changed(127), "0100007f01", "0100007f01"),
        (_changed(128), "010080008001", "0100008001"),
        (_changed(255), "01008000ff01", "010000ff01"),
        (_changed(256), "010080010001", "010080010001"),
        (_changed(10, 13, values=[1, 2]), "0100030a01000002", "0100030a01000002"),
        (_changed(10, 14, values=[1, 2]), "0200000a01000302", "0200000a01000302"),
        (_changed(*range(128)), "01007f00" + "01" * 128, "01007f00" + "01" * 128),
        (_changed(*range(129)), "0100880000" + "01" * 129, "0100880000" + "01" * 129),
    ],
)
def test_diff_vectors(page, narrow, wide):
    assert (_diff(page, 128).hex(), _diff(page, 256).hex()) == (narrow, wide)
    assert codec.apply_diff(bytes(4096), codec.read_diff(Reader(bytes.fromhex(narrow)))) == page


def test_threshold_and_split():
    assert (len(_diff(_changed(*range(4087)))), len(_diff(_changed(*range(4088))))) == (4095, 4096)
    assert [p[2] for p in find_patches(_changed(*range(2049)), bytes(4096))] == [2048, 1]


def test_header():
    raw = codec.header("interdedupdeltagzip", 4096, 8192)
    assert raw.hex() == "4d42435200696e746572646564757064656c7461677a69700002000100001000000020000000000000"
    assert codec.read_header(Reader(raw)) == {"method": "interdedupdeltagzip", "major": 2, "minor": 1, "pagesize": 4096, "uncompressed_size": 8192}


def test_runs():
    assert small.runs([1, 2, 3, 5, 6, 7, 8, 9, 13]) == [(1, 3), (5, 9), (13, 13)]
    assert small.runs([]) == []


def test_methods():
    assert len(set(codec.METHODS)) == 23
    assert all(str(Method.parse(m)) == m for m in codec.METHODS)
    for bad in ("", "interdedupzip", "intradedupdelta", "deltagzip", "interdedupdeltanointra"):
        with pytest.raises(FormatError):
            Method.parse(bad)


def test_bad_input():
    for call in (
        lambda: codec.interval(1 << 29, 1 << 29, True), lambda: codec.patch_header(5000, 1), lambda: codec.page_numbers([5, 5]), lambda: codec.compress(b"", "zip"),
        lambda: Reader(b"abc").text(), lambda: codec.read_header(Reader(b"NOPE\0x\0")), lambda: codec.read_interval_list(Reader(b"\0\0\0\0")),
    ):
        with pytest.raises(FormatError):
            call()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 2), unique=True, max_size=30).map(sorted))
def test_page_numbers_round_trip(numbers):
    assert codec.read_page_numbers(Reader(codec.page_numbers(numbers))) == numbers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**29 - 1), st.integers(0, 70_000)), min_size=1, max_size=10))
def test_intervals_round_trip(pairs):
    pairs = [(a, a + n) for a, n in pairs]
    assert codec.read_interval_list(Reader(codec.interval_list(pairs))) == pairs


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=600), st.sampled_from(codec.METHODS), st.sampled_from([1, 16, 64]))
def test_any_snapshot_round_trips(src, ref, name, pagesize):
    assert small.unpack(small.pack(src, ref, Method.parse(name), pagesize, "x"), ref) == src
    near = src[:100] + bytes(b ^ (k % 17 == 0) for k, b in enumerate(src[100:]))
    assert small.unpack(small.pack(near, src, Method.parse(name), pagesize, "x"), src) == near


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=64, max_size=64), st.binary(min_size=64, max_size=64))
def test_patches_apply(a, b):
    patches = find_patches(a, b)
    assert codec.apply_diff(b, [(off, x) for _, off, _, x in patches]) == a
    assert codec.read_diff(Reader(codec.diff([(off, x) for _, off, _, x in patches]))) == [(off, x) for _, off, _, x in patches]


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 70_000])
@pytest.mark.parametrize("level", [0, 6, 9])
def test_xz_dictionary_fits_the_input(n, level):
    """Decoded within the memory that a dictionary of the input's size needs, and packed as well as with the preset's."""
    half = random.Random(n).randbytes(n // 2)
    raw = half + half + b"x" * (n % 2)
    packed = codec.compress(raw, "7zip", level)
    assert lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=200_000 + 2 * max(n, 4096)).decompress(packed) == raw
    assert abs(len(packed) - len(lzma.compress(raw, lzma.FORMAT_XZ, preset=level))) <= 8
    assert codec.decompress(packed, "7zip") == raw
