"""Queries by name, and the SQL that checks them."""

from candela.plans import analysis, cohorts, common, extras, market, patterns, reports, structures
from candela.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "cohorts", "common", "extras", "market", "patterns", "reports", "structures"]
