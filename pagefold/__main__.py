"""Command line: ``python -m pagefold compress|intra|whole|decompress ...``."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys

from .functions.codec import INNER, FormatError, Method, Reader, read_header

log = logging.getLogger("pagefold")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagefold", description="Compress and restore binary snapshots against a reference.")
    p.add_argument("--log-file", help="also log to this file, up to 10 of 1 MiB")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str, codecs=INNER):
        c = sub.add_parser(name, help=text)
        for x in paths:
            c.add_argument(x)
        c.add_argument("--overwrite", action="store_true")
        if name != "decompress":
            c.add_argument("--pagesize", type=int, default=4096)
            c.add_argument("--inner", choices=codecs, default=codecs[0])
            c.add_argument("--level", type=int, default=9)
        return c

    c = command("compress", "store what differs from a reference", "reference", "source", "target")
    c.add_argument("--nointra", action="store_true", help="keep equal new pages apart")
    c.add_argument("--delta", action="store_true", help="store similar pages as diffs")
    command("intra", "deduplicate a snapshot by itself", "source", "target")
    command("whole", "compress a file as it is", "source", "target", codecs=INNER[1:])
    command("decompress", "restore a snapshot", "source", "target")
    return p


def _log_to(path: str | None, verbose: bool) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=1 << 20, backupCount=10))
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    _log_to(a.log_file, a.verbose)
    mode = "overwrite" if a.overwrite else "errorifexists"
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .operators import stats
    from .sources import archive

    try:
        if a.command == "whole":
            archive.compress_whole(a.source, a.target, a.inner, a.level, mode, a.pagesize)
            return 0
        spark = spark or SparkSession.builder.appName("pagefold").getOrCreate()
        if a.command == "compress":
            classified = archive.compress(spark, a.reference, a.source, a.target, a.pagesize, not a.nointra, a.delta, a.inner, a.level, mode)
            for name, value in stats.inter_stats(classified).first().asDict().items():
                log.info("%s: %s", name, value)
        elif a.command == "intra":
            archive.compress_intra(spark, a.source, a.target, a.pagesize, a.inner, a.level, mode)
        else:
            with open(a.source, "rb") as f:
                log.info("%s", Method.parse(read_header(Reader(f.read(4096)))["method"]))
            archive.decompress(spark, a.source, a.target, mode=mode)
    except (OSError, FormatError, PySparkException) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
