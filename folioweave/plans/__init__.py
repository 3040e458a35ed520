"""The core's named queries."""

from __future__ import annotations


def load():
    """(queries, SQL) of all plan modules."""
    from . import derived, index, layout, lines, lookups, outline, outlines, quality, registry, services, structure

    assert all((derived, index, layout, lines, lookups, outline, outlines, quality, services, structure))
    return dict(registry.QUERIES), dict(registry.ORACLE)
