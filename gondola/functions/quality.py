"""Quality gates of staged candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import reasons
from .text import trim_space

# Fixed values.
MAX_SANE_PRICE = 1_500_000
SPIKE_FACTOR = 5


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(trim_space(text)) > 0, F.lit(False))


def has_items(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def gates(average: Column) -> list[tuple[str, bool, Column]]:
    """(flag, blocks, passes) in flag order; ``average`` is the historical mean price."""
    price = F.col("price").cast("double")
    no_price = price.isNull()
    unknown_average = average.isNull() | (average <= 0)
    return [
        ("valid_ean", True, F.coalesce(F.col("ean").rlike(r"^\d{8,14}$"), F.lit(False))),
        ("has_name", True, has_text(F.col("name"))),
        ("price_positive", True, no_price | (price > 0)),
        ("price_sane", True, no_price | (price < MAX_SANE_PRICE)),
        ("price_no_spike", True, no_price | unknown_average | (price <= average * SPIKE_FACTOR)),
        ("has_brand", False, has_text(F.col("brand"))),
        ("has_image", False, F.coalesce(F.col("image_url") != "", F.lit(False)) | has_items(F.col("images"))),
        ("has_category", False, has_text(F.col("category"))),
    ]


def verdict(average: Column) -> dict[str, Column]:
    """quality_flags, quality_score and status columns."""
    rules = gates(average)
    flags = reasons([(name, ~ok) for name, _, ok in rules])
    soft = [ok for _, blocks, ok in rules if not blocks]
    passed = sum((ok.cast("int") for ok in soft[1:]), soft[0].cast("int"))
    blocked = [~ok for _, blocks, ok in rules if blocks]
    any_blocked = blocked[0]
    for b in blocked[1:]:
        any_blocked = any_blocked | b
    return {
        "quality_flags": flags,
        "quality_score": passed / F.lit(float(len(soft))),
        "status": F.when(any_blocked, "REJECTED").otherwise("PENDING"),
    }


def completeness() -> Column:
    """One point each for brand, description, image, images, category and price."""
    points = [
        has_text(F.col("brand")), has_text(F.col("description")), has_text(F.col("image_url")),
        has_items(F.col("images")), has_text(F.col("category")), F.col("price").isNotNull(),
    ]
    return sum((p.cast("int") for p in points[1:]), points[0].cast("int"))
