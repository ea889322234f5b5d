"""Every registered query with the SQL text that checks it."""

from chainevents.plans.catalog import archives, coverage, scopes, stored  # noqa: F401
from chainevents.plans.catalog.sample import REGISTRY

__all__ = ["REGISTRY"]
