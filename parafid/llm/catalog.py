"""All queries of this subpackage."""

from . import (alignment, decontam, hyperplanes, langid, licenses, markov, mixing, packing, pii, resampling, simhash,  # noqa: F401
               toolcalls, warc)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
