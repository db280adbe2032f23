"""Registered queries over the benchmark tables, each with its SQL equivalent."""

from . import chains, corpus, history, long_tables, packages, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
