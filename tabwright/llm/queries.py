"""All queries of this subpackage."""

from tabwright.llm import (ann, decontamination, language_id, near_dedup, packing, pieces, quality, ranking,  # noqa: F401
                           repeats, runs, secrets, token_counts, warc)
from tabwright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
