"""Several analyses put together."""

from tallyframe.plans.investigate import Investigation, investigate
from tallyframe.plans.narrative import investigation_steps, kpi_summary
from tallyframe.plans.report import report_bundle

__all__ = ["Investigation", "investigate", "investigation_steps", "kpi_summary", "report_bundle"]
