"""Imports every plan module so that its queries are registered."""

from trialframe.plans import feature_plans, metric_plans, model_plans, retrieval_plans, signal_plans, tables_plans  # noqa: F401
from trialframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
