"""KPI analytics over Spark DataFrames.

Layers, lowest first: ``functions`` (column expressions), ``sources`` (reading
and writing tables), ``operators`` (DataFrame in, DataFrame out) and ``plans``
(several operators put together: summary, report, investigation).
"""

from tallyframe.settings import AOV, KPI_NAMES, ORDERS, REVENUE, Settings

__all__ = ["AOV", "KPI_NAMES", "ORDERS", "REVENUE", "Settings"]
