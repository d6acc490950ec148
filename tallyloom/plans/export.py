"""The result files a dashboard reads: one headed CSV per analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tallyloom.operators.experiment import Experiment, ab_test_groups, ab_test_readout
from tallyloom.operators.funnel import event_funnel, fulfillment_funnel
from tallyloom.operators.retention import cohort_pivot, cohort_retention
from tallyloom.operators.sales import kpi_summary
from tallyloom.session import cut_lineage
from tallyloom.sources.sinks import with_provenance, write_report


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """KPI row, cohort retention long and wide, fulfilment funnel."""
    # The wide form reads the long one twice; it has one row per pair of months.
    cohorts = cut_lineage(cohort_retention(tables["orders"]))
    reports = {
        "kpi_summary": kpi_summary(
            tables["customers"], tables["orders"], tables["order_items"], tables["products"], tables["sellers"]
        ),
        "cohort_retention": cohorts.orderBy("cohort_month", "months_since_cohort"),
        "cohort_retention_pivot": cohort_pivot(cohorts),
        "funnel_fulfillment": fulfillment_funnel(tables["orders"]),
    }
    return _write(reports, folder)


def export_experiment(attempts: DataFrame, arm: str, success: str, experiment: Experiment, folder: str) -> list[str]:
    """Groups and summary of one test."""
    reports = {
        "ab_test_results": ab_test_groups(attempts, arm, success, experiment),
        "ab_test_summary": ab_test_readout(attempts, arm, success, experiment),
    }
    return _write(reports, folder)


def export_discovery_funnel(
    events: DataFrame, steps: Sequence[tuple[str, str]], within_hours: int, folder: str
) -> list[str]:
    """The discovery funnel, measured from events, with its provenance."""
    method = f"measured: each step at most {within_hours} hours after the one before"
    funnel = with_provenance(event_funnel(events, steps, within_hours), False, method)
    return _write({"funnel_discovery": funnel}, folder)


def _write(reports: Mapping[str, DataFrame], folder: str) -> list[str]:
    for name, df in reports.items():
        write_report(df, f"{folder}/{name}")
    return list(reports)
