"""Query catalogue over the star schema."""

from importlib import import_module

MODULES = ["q_sources", "q_joins", "q_aggregates", "q_windows", "q_scalars", "q_domain", "q_models",
           "q_streaming"]


def load():
    """Import every query module that exists and return the registry."""
    from .registry import QUERIES
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES
