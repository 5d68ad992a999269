"""The library's operators; importing a module registers what it holds."""

import importlib

_MODULES = ("relational", "sampling", "joins", "windows", "text", "ngrams", "sentiment", "dedup", "metrics", "sinks", "archives", "ml", "branching", "lexicons")


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"weftline.operators.{name}")
