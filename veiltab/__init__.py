"""veiltab: differentially private synthetic tables, computed by Spark."""

from veiltab.operators.domain import Column, Domain
from veiltab.plans.synthesizer import TableSynthesizer

__all__ = ["Column", "Domain", "TableSynthesizer"]
