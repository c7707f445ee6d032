"""Operators that prepare training text. Nothing else in the package imports this one."""

from salestally.llm import (  # noqa: F401
    bpe, jaccard, lm, mixing, negatives, pii, quality, repeats, rules, spelling, token_files, tokens, vectors,
)
from salestally.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
