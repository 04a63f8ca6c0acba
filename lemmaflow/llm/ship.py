"""Sending this package to the executors (``plans.ship``)."""

from ..plans.ship import ship_package

__all__ = ["ship_package"]
