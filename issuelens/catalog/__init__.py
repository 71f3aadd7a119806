"""Queries over the driver's tables, one per operator."""

from . import aggs_q, joins_q, models_q, rules_q, sources_q, text_q  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
