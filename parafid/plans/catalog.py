"""All registered queries."""

from . import q_evaluate, q_extract, q_match, q_report, q_terms, q_text, q_validate  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
