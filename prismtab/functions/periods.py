"""Calendar buckets and their text forms."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


def bucket(value: Column, grain: str) -> Column:
    """First day of the bucket; weeks start on Monday."""
    return F.to_date(F.date_trunc(_known(grain), value))


def bucket_label(start: Column, grain: str) -> Column:
    """Label day of a resampled bucket: weeks carry their Sunday, months their last day."""
    _known(grain)
    if grain == "week":
        return F.date_add(start, 6)
    if grain == "month":
        return F.last_day(start)
    return start


def period_text(start: Column, grain: str) -> Column:
    """Text form of a period: ``2026-05``, ``2026-04-27/2026-05-03``, ``2026Q2``, ``2026``."""
    _known(grain)
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    if grain == "year":
        return F.date_format(start, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
    if grain == "week":
        return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))
    return start.cast("string")


def spine(first: Column, last: Column, grain: str) -> Column:
    """Every bucket start from the first to the last, as an array."""
    step = {
        "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH",
        "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR",
    }[_known(grain)]
    return F.sequence(first, last, F.expr(step))


def _known(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    return grain
