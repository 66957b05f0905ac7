"""Robustness analytics for model predictions, as Spark DataFrame jobs."""

from steadymark.session import build_session

__all__ = ["build_session"]
