"""Parameters of a report run: plain Python dates, a payer and the region list."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from careledger.functions.fixed_values import FLAGGED_REGION_IDS


@dataclass(frozen=True)
class Params:
    """What a caller chooses for a run.

    ``start`` and ``end`` bound report A (both inclusive). ``as_of`` stands for
    "today": it bounds tickets in both reports and fixes the rolling window of
    report B, so that a rerun of the same day gives the same rows.

    ``hot_orders`` names order ids with more rows than a task can take, and how many;
    :func:`careledger.plans.hot.find_hot_orders` finds them. Without any, every order
    goes through the plain joins.
    """

    start: date
    end: date
    as_of: date
    platform_payer: str
    flagged_regions: frozenset[str] = field(default=FLAGGED_REGION_IDS)
    months: int = 6
    strict_ticket_ids: bool = True
    hot_orders: Mapping[str, int] = field(default_factory=dict)
