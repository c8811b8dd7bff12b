"""Registered queries: each is a library call on the given tables with, where SQL can say it, the same question in SQL."""

from queries import analytics, cleaning, investigation, jobs, logs, sources, text, trending, web  # noqa: F401
from queries.base import REGISTRY

__all__ = ["REGISTRY"]
