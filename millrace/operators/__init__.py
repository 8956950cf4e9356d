"""Operators over plans: rows (project, filter, union, limit) and aggregation."""

from millrace.operators.aggregation import aggregate, group_by
from millrace.operators.rows import custom, filter_, limit, project, union

__all__ = ["aggregate", "custom", "filter_", "group_by", "limit", "project", "union"]
