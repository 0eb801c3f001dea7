"""Every operator of this subpackage as a query over its whole table."""

from groundwell.llm import (  # noqa: F401
    chat, collocations, decontamination, jaccard, licenses, line_dedup, mixing, neighbours, pieces, quality, ranking, secrets, tokens)
from groundwell.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
