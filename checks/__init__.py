"""Query and SQL pairs over the given tables, one module per operator family."""

from importlib import import_module

MODULES = ("functions", "retrieval", "routing", "lifecycle", "mining", "curation", "chains",
           "evaluation", "files", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
