"""All registered queries."""

from . import q_claims, q_frames, q_metrics, q_resample, q_text, q_validate  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
