"""All registered queries, in one import."""

from duepath.plans import audit_queries, feature_queries, history_queries, matrix_queries, metric_queries, score_queries, source_queries  # noqa: F401
from duepath.plans.registry import ORACLE, QUERIES  # noqa: F401
