"""Whole archives of small snapshots, in one call and without Spark.

For tables that hold very many snapshots, each of a few pages: one group of
rows is one archive.  Large snapshots go through ``sources.archive``.
"""

from __future__ import annotations

from ..operators.diff import find_patches
from . import codec
from .codec import Method


def pages_of(raw: bytes, pagesize: int) -> list[bytes]:
    return [raw[k : k + pagesize] for k in range(0, len(raw), pagesize)]


def runs(places: list[int]) -> list[tuple[int, int]]:
    """Closed runs of ascending numbers."""
    out: list[tuple[int, int]] = []
    for n in places:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def pack(src: bytes, ref: bytes, method: Method, pagesize: int, ref_path: str = "", short_off_limit: int = 256, level: int = 9) -> bytes:
    head = codec.header(str(method), pagesize, len(src))
    if method.kind == "whole":
        return head + codec.compress(src, method.inner, level)
    pages = pages_of(src, pagesize)
    if method.kind == "intradedup":
        places: dict[bytes, list[int]] = {}
        for k, p in enumerate(pages):
            places.setdefault(p, []).append(k)
        often = [(p, x) for p, x in places.items() if len(x) > 1]
        body = [len(often).to_bytes(4, "little"), *(p for p, _ in often), *(codec.interval_list(runs(x)) for _, x in often), *(p for p in pages if len(places[p]) == 1)]
        return head + codec.compress(b"".join(body), method.inner, level)
    old, first = pages_of(ref, pagesize), {}
    for k, p in enumerate(old):
        first.setdefault(p, k)
    dedup: dict[int, list[int]] = {}
    diffs: list[tuple[int, bytes]] = []
    new: dict[bytes, list[int]] = {}
    for k, p in enumerate(pages):
        if k < len(old) and p == old[k]:
            continue
        if p in first:
            dedup.setdefault(first[p], []).append(k)
            continue
        if method.delta and k < len(old) and len(p) == len(old[k]) == pagesize:
            d = codec.diff([(off, b) for _, off, _, b in find_patches(p, old[k])], short_off_limit)
            if len(d) < pagesize:
                diffs.append((k, d))
                continue
        new.setdefault(p, []).append(k)
    body = [codec.text(ref_path), codec.page_numbers(sorted(dedup)), *(codec.interval_list(runs(dedup[n])) for n in sorted(dedup))]
    if method.delta:
        body += [codec.page_numbers([k for k, _ in diffs]), *(d for _, d in diffs)]
    if method.intra:
        body += [len(new).to_bytes(4, "little"), *(codec.interval_list(runs(x)) for x in new.values()), *new]
    else:
        body += [codec.interval_list(runs(sorted(k for x in new.values() for k in x))), *(pages[k] for k in sorted(k for x in new.values() for k in x))]
    return head + codec.compress(b"".join(body), method.inner, level)


def unpack(archive: bytes, ref: bytes = b"") -> bytes:
    from ..sources.archive import parse

    a = parse(archive)
    if a["kind"] == "whole":
        return a["content"]
    pages: list[bytes | None] = [None] * a["n_pages"]
    filled = [*a["new"], *a["fills"]]
    old = pages_of(ref, a["pagesize"])
    filled += [(old[n], x) for n, x in a["dedup"]]
    for content, where in filled:
        for left, right in where:
            pages[left : right + 1] = [content] * (right + 1 - left)
    for k, patches in a["diffs"]:
        pages[k] = codec.apply_diff(old[k], patches)
    rest = iter(a["literals"])
    return b"".join(p if p is not None else next(rest) if a["kind"] == "intradedup" else old[k] for k, p in enumerate(pages))
