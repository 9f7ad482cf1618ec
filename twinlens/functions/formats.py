"""Text cells of report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_cell(estimate: Column, low: Column, high: Column) -> Column:
    """``0.123 [0.100, 0.140]``"""
    return F.format_string("%.3f [%.3f, %.3f]", estimate.cast("double"), low.cast("double"), high.cast("double"))
