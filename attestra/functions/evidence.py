"""Evidence class and currency of one claim."""
from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import Registry
from .text import cell, lookup

CURRENT, STALE, UNDATED = "current", "stale", "currency-unknown"


def evidence_tier(reg: Registry, verified: Column, root: Column, heuristic: Column) -> Column:
    by_method = F.coalesce(lookup(reg.analysis["tier_of_heuristic"], F.coalesce(heuristic, F.lit(""))),
                           F.lit(reg.analysis["tier_default"]))
    return F.when(verified | root.isin(reg.verified_roots), reg.analysis["tier_order"][0]).otherwise(by_method)


def tier_rank(reg: Registry, tier: Column) -> Column:
    order = reg.analysis["tier_order"]
    return F.coalesce(lookup({t: str(i) for i, t in enumerate(order)}, tier).cast("int"), F.lit(len(order)))


def iso_day(lastmod: Column) -> Column:
    """The date of a revision cell; only YYYY-MM-DD counts, anything else is no date."""
    day = F.substring(cell(lastmod), 1, 10)
    return F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))


def currency_status(reg: Registry, lastmod: Column, as_of: Column | datetime.date) -> Column:
    """current / stale / currency-unknown against a stated day, never the clock."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    day = iso_day(lastmod)
    years = F.datediff(today, day) / F.lit(float(reg.analysis["days_per_year"]))
    return (F.when(day.isNull(), UNDATED)
            .when(years > F.lit(float(reg.analysis["staleness_years"])), STALE).otherwise(CURRENT))


def normal_date(c: Column) -> Column:
    return F.substring(cell(c), 1, 10)
