"""Indicator-panel analytics on Spark."""

from tidepanel.model import Panel, Selection

__all__ = ["Panel", "Selection"]
