"""Queries and statements of the corpus operators, for the driver's entry file."""

from stockweave.llm import corpus_queries  # noqa: F401
from stockweave.llm.common import ORACLES, QUERIES  # noqa: F401
