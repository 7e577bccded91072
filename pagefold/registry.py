"""References kept for many requests, and requests as futures."""

from __future__ import annotations

import os
import threading
import time
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .functions.codec import FormatError
from .sources import archive
from .sources.dump import read_pages


class Registry:
    """``add_reference``, ``del_reference``, ``compress`` and ``decompress``; jobs run side by side.

    A reference is known by its path and page size; adding one again replaces it, deleting an unknown
    one does nothing.  A request's future carries its result or its error; a request that fails for
    other reasons than what was asked is tried ``attempts`` times, ``pause`` seconds apart.  References
    that nobody has used for a while are let go by ``expire`` and loaded again when needed.
    """

    #: Errors of the request itself: trying again would not help.
    FINAL = (FormatError, FileExistsError, FileNotFoundError, ValueError)

    def __init__(self, spark: SparkSession, workers: int = 4, attempts: int = 3, pause: float = 30.0):
        self.spark, self._pages, self._used, self._lock = spark, {}, {}, threading.Lock()
        self._pool, self.attempts, self.pause = ThreadPoolExecutor(workers), attempts, pause

    def _submit(self, work) -> Future:
        def tried():
            for left in range(self.attempts - 1, -1, -1):
                try:
                    return work()
                except self.FINAL:
                    raise
                except Exception:
                    if not left:
                        raise
                    time.sleep(self.pause)

        return self._pool.submit(tried)

    def expire(self, seconds: float) -> list[tuple[str, int]]:
        """Lets go of references that no request has used for so long, and returns them."""
        with self._lock:
            old = [k for k in self._pages if time.monotonic() - self._used.get(k, 0.0) >= seconds]
            gone = [self._pages.pop(k) for k in old]
        for pages in gone:
            pages.unpersist()
        return sorted(old)

    def _load(self, path: str, pagesize: int) -> DataFrame:
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
        return read_pages(self.spark, path, pagesize).persist()

    def add_reference(self, path: str, pagesize: int = 4096) -> DataFrame:
        pages = self._load(path, pagesize)
        with self._lock:
            old, self._pages[path, pagesize] = self._pages.get((path, pagesize)), pages
            self._used[path, pagesize] = time.monotonic()
        if old is not None and old is not pages:
            old.unpersist()
        return pages

    def del_reference(self, path: str, pagesize: int | None = None) -> None:
        with self._lock:
            gone = [self._pages.pop(k) for k in list(self._pages) if k[0] == path and pagesize in (None, k[1])]
        for pages in gone:
            pages.unpersist()

    def reference(self, path: str, pagesize: int = 4096) -> DataFrame:
        with self._lock:
            self._used[path, pagesize] = time.monotonic()
            if (path, pagesize) in self._pages:
                return self._pages[path, pagesize]
        pages = self._load(path, pagesize)  # outside the lock
        with self._lock:
            return self._pages.setdefault((path, pagesize), pages)

    def references(self) -> list[tuple[str, int]]:
        with self._lock:
            return sorted(self._pages)

    def compress(self, ref_path: str, src_path: str, target: str, pagesize: int = 4096, **how) -> Future:
        return self._submit(lambda: archive.compress(self.spark, ref_path, src_path, target, pagesize, ref=self.reference(ref_path, pagesize), **how))

    def decompress(self, path: str, target: str, mode: str = "errorifexists") -> Future:
        def work():
            a = archive.read_archive(path)
            ref = self.reference(a["ref_path"], a["pagesize"]) if a["kind"] == "interdedup" else None
            return archive.decompress(self.spark, path, target, ref, mode)

        return self._submit(work)

    def close(self) -> None:
        self._pool.shutdown(wait=True)
        for path, pagesize in self.references():
            self.del_reference(path, pagesize)
