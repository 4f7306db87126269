"""All queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from probewise.llm import divergence, exact_dedup, html_text, jaccard_join, licenses, mixing, mtree, packing, periods, prefix_trie, rule_classifier, secrets, tokens
from probewise.llm.common import QUERIES, SQL

MODULES = (
    divergence, exact_dedup, html_text, jaccard_join, licenses, mixing, mtree, packing, periods, prefix_trie, rule_classifier, secrets, tokens
)

__all__ = ["MODULES", "QUERIES", "SQL"]
