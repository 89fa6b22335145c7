"""careledger: what customer-care problems cost per order, as Spark jobs."""

from careledger.functions.windows import PaddedWindow, RollingWindow, WindowSet
from careledger.params import Params
from careledger.plans.hot import find_hot_orders
from careledger.plans.report_a import report_a, stages_a
from careledger.plans.report_b import report_b, stages_b
from careledger.plans.sweep import sweep
from careledger.sources.fixtures import fixture_tables
from careledger.sources.tables import read_tables, write_days, write_report

__all__ = [
    "PaddedWindow",
    "Params",
    "RollingWindow",
    "WindowSet",
    "find_hot_orders",
    "fixture_tables",
    "read_tables",
    "report_a",
    "report_b",
    "stages_a",
    "stages_b",
    "sweep",
    "write_days",
    "write_report",
]
