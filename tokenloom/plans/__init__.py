"""Registered queries; importing the modules fills the registry."""

from tokenloom.plans import batches, chats, corpus, reports, streams  # noqa: F401
from tokenloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
