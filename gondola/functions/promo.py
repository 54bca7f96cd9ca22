"""Discounts, promotional unit prices and price movements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .freshness import at
from .numeric import currency

PERCENT_KINDS = ("wallet_discount", "bank_discount", "percentage")

# Stored promotion kinds and their public names.
PUBLIC_KIND = {
    "TWO_FOR_ONE": "2x1",
    "SECOND_HALF": "2nd_50",
    "WALLET_DISCOUNT": "wallet_discount",
    "BANK_DISCOUNT": "bank_discount",
    "PERCENTAGE": "percentage",
}


def public_kind(stored: Column) -> Column:
    rule = None
    for key, value in PUBLIC_KIND.items():
        rule = F.when(stored == key, value) if rule is None else rule.when(stored == key, value)
    return rule.otherwise("percentage")


def _discounted(price: Column, list_price: Column) -> Column:
    return (list_price > price) & (list_price > 0)


def discount_percent(price: Column, list_price: Column) -> Column:
    p, l = price.cast("double"), list_price.cast("double")
    return F.when(_discounted(p, l), (l - p) / l * 100.0)


def discount_amount(price: Column, list_price: Column) -> Column:
    p, l = price.cast("double"), list_price.cast("double")
    return F.when(_discounted(p, l), currency(l - p))


def promotional_price(base: Column, kind: Column, discount: Column) -> Column:
    b, d = base.cast("double"), discount.cast("double")
    return F.when(
        b > 0,
        F.when(kind == "2x1", currency(b / 2.0))
        .when(kind == "2nd_50", currency(b * 0.75))
        .when(kind.isin(*PERCENT_KINDS) & (d > 0) & (d <= 100), currency(b * (1.0 - d / 100.0))),
    )


def delta_amount(current: Column, previous: Column) -> Column:
    c, p = current.cast("double"), previous.cast("double")
    return F.when(c.isNotNull() & (p > 0), currency(c - p))


def delta_percent(current: Column, previous: Column) -> Column:
    p = previous.cast("double")
    return F.when(p > 0, currency(delta_amount(current, previous) / p * 100.0))


def drop_amount(current: Column, previous: Column) -> Column:
    c, p = current.cast("double"), previous.cast("double")
    return F.when((p > 0) & (c < p), currency(p - c))


def drop_percent(current: Column, previous: Column) -> Column:
    return currency(drop_amount(current, previous) / previous.cast("double") * 100.0)


def running(is_active: Column, start: Column, end: Column, now) -> Column:
    """Active flag set and now inside the (open-ended) date window."""
    t = at(now)
    return is_active & (start.isNull() | (start <= t)) & (end.isNull() | (end >= t))


def lifecycle(is_active: Column, start: Column, end: Column, now) -> Column:
    t = at(now)
    return (
        F.when(~is_active, "inactive")
        .when(start > t, "scheduled")
        .when(end < t, "expired")
        .otherwise("active")
    )
