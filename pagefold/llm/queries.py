"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("rules", "substrings", "near", "chat", "urls", "contamination", "language", "classifier", "pieces", "licenses")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
