"""Registered queries; importing the package registers all of them."""

from gavel.workload import board_queries, task_queries, text_queries  # noqa: F401
from gavel.workload.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
