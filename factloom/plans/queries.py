"""All registered queries."""

from factloom.plans import q_code, q_report, q_text, q_truth  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES  # noqa: F401
