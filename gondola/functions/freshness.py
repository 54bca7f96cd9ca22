"""Age of a price against the freshness limit of its store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MAX_AGE_HOURS = 24
MICROS_PER_HOUR = 3_600_000_000
FRESH, STALE, UNKNOWN = "fresh", "stale", "unknown"


def at(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def age_micros(checked_at: Column, now) -> Column:
    """Microseconds since the check; a future check has age 0."""
    return F.greatest(F.lit(0), F.unix_micros(at(now)) - F.unix_micros(checked_at))


def max_age_hours(limit: Column) -> Column:
    return F.when(limit > 0, limit).otherwise(F.lit(DEFAULT_MAX_AGE_HOURS))


def freshness(checked_at: Column, limit_hours: Column, now) -> Column:
    allowed = (max_age_hours(limit_hours) * F.lit(MICROS_PER_HOUR)).cast("bigint")
    return (
        F.when(checked_at.isNull(), UNKNOWN)
        .when(age_micros(checked_at, now) <= allowed, FRESH)
        .otherwise(STALE)
    )


def freshness_rank(status: Column) -> Column:
    return F.when(status == FRESH, 0).when(status == STALE, 1).otherwise(2)


def rank_to_freshness(rank: Column) -> Column:
    return F.when(rank == 0, FRESH).when(rank == 1, STALE).otherwise(UNKNOWN)


def age_hours(checked_at: Column, now) -> Column:
    return age_micros(checked_at, now) / F.lit(float(MICROS_PER_HOUR))


def age_days(checked_at: Column, now) -> Column:
    return F.floor(age_micros(checked_at, now) / F.lit(float(24 * MICROS_PER_HOUR))).cast("bigint")


def age_bucket(checked_at: Column, limit_hours: Column, now) -> Column:
    """within_sla, then up to 7 days, up to 30 days, over 30 days; unknown without a check."""
    status = freshness(checked_at, limit_hours, now)
    age = age_micros(checked_at, now)
    day = 24 * MICROS_PER_HOUR
    return (
        F.when(status == UNKNOWN, "unknown")
        .when(status == FRESH, "within_sla")
        .when(age <= F.lit(7 * day), "up_to_7d")
        .when(age <= F.lit(30 * day), "up_to_30d")
        .otherwise("over_30d")
    )
