"""Surrogate fixtures and the registry of study queries."""

from __future__ import annotations


def all_queries():
    """Import every query module (each registers itself) and return the registry."""
    from expstudy.plans import registry  # noqa: F401
    from expstudy.plans import registry_models  # noqa: F401
    from expstudy.plans import registry_io  # noqa: F401
    from expstudy.plans import registry_wide  # noqa: F401
    from expstudy.plans import registry_checks  # noqa: F401

    return dict(registry.REGISTRY)
