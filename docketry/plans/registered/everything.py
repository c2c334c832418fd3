"""All registered queries, in one place."""

from docketry.plans.registered import (  # noqa: F401
    aggregated,
    checked,
    cleaned,
    files,
    flow,
    linked,
    read,
    resolved,
)
from docketry.plans.registered.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
