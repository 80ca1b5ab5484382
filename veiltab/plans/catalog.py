"""All registered queries."""

from veiltab.plans import queries_private, queries_stats, queries_synth, queries_tables  # noqa: F401
from veiltab.plans.registry import ORACLES, QUERIES

FLAGSHIP = "f5_marginals_dense"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
