"""Every operator as a query over the given tables."""

from parlance.plans import chats, evaluation, names, opinions, reactions, search, support, vectors  # noqa: F401
from parlance.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
