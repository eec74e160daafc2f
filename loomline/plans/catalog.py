"""All queries of the conversation operators, and the same in SQL."""

from loomline.plans import code_plans, line_plans, quality_plans, sequence_plans, state_plans, text_plans, zone_plans  # noqa: F401
from loomline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
