"""Column roles of a transaction table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

REVENUE = "Revenue"
ORDERS = "Orders"
AOV = "Average Order Value"
KPI_NAMES = (REVENUE, ORDERS, AOV)

# Defaults of the analyses: z-score threshold and months to forecast.
DEFAULT_Z_THRESHOLD = 1.5
DEFAULT_FORECAST_STEPS = 3


@dataclass(frozen=True)
class Settings:
    """Which column plays which role.

    ``date_format`` is only used when ``date_col`` holds strings; left out, it
    is measured on the data, which costs one extra job. ``approximate_orders``
    estimates distinct orders (about 5 % off), which saves shuffling their ids.
    """

    date_col: str
    revenue_col: str | None = None
    order_col: str | None = None
    date_format: str | None = None
    approximate_orders: bool = False
    segment_col: str | None = None

    def override(
        self,
        df: DataFrame,
        date_col: str | None = None,
        revenue_col: str | None = None,
        order_col: str | None = None,
        segment_col: str | None = None,
    ) -> Settings:
        """Take each given column if the table has it, else keep the selected one."""
        return replace(
            self,
            date_col=pick_column(df, date_col, self.date_col),
            revenue_col=pick_column(df, revenue_col, self.revenue_col),
            order_col=pick_column(df, order_col, self.order_col),
            segment_col=pick_column(df, segment_col, self.segment_col),
        )


def pick_column(df: DataFrame, name: str | None, fallback: str | None) -> str | None:
    """``name`` if it is a column of ``df``, else ``fallback``."""
    return name if name in df.columns else fallback
