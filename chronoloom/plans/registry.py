"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import detection_plans, find_plans, interval_plans, name_plans, record_plans, text_plans, vocabulary_plans
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "detection_plans", "find_plans", "interval_plans", "name_plans", "record_plans", "text_plans", "vocabulary_plans"]
