"""Queries of the core, one registry for all modules."""

from vellum.registry import Registry

REGISTRY = Registry()


def load() -> Registry:
    """Import every module of queries; each registers its own."""
    from vellum.plans import account, curation, integrity, records, relational, retrieval, texts  # noqa: F401

    return REGISTRY
