"""All registered queries of this folder."""

from factloom.llm import q_codes, q_leaks, q_near, q_pages, q_phrases, q_quality, q_tokens  # noqa: F401
from factloom.llm.registry import ORACLES, QUERIES  # noqa: F401
