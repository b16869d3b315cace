"""Query plans registered for the driver (one module per operator family)."""

from importlib import import_module

_MODULES = ["dashboard_q", "kb_search_q", "kb_text_q", "records_q", "reports_q", "rules_q", "functions_q", "streams_q"]


def load_all():
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
    from .registry import QUERIES
    return QUERIES
