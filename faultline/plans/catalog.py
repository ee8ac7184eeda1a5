"""All registered queries."""

from faultline.plans import q_code, q_groups, q_jobs, q_kb, q_review, q_scoring, q_text  # noqa: F401
from faultline.plans.registry import CHECKS, QUERIES  # noqa: F401
