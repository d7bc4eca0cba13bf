"""Registered queries (Spark builder + DuckDB oracle SQL), one module per family."""

from . import disparity  # noqa: F401  (registers on import)
from .registry import HEADLINE, ORACLE, QUERIES  # noqa: F401


def _load_all():
    import importlib
    for mod in ("choices", "generation", "scoring", "textops", "incremental", "streams", "roundtrip"):
        try:
            importlib.import_module(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:       # family not built yet
            if e.name != f"{__name__}.{mod}":
                raise


_load_all()
