"""Named checks collected into a list of failed reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks whose condition is true, in order; a null condition does not fail.

    Joined and split as text (names hold no comma), which stays in generated code
    where a filter over an array of candidates would be interpreted per row.
    """
    joined = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in checks])
    return F.when(F.length(joined) > 0, F.split(joined, ",")).otherwise(F.array().cast("array<string>"))


def verdict_of(fails: Column, warns: Column) -> Column:
    return F.when(fails, "FAIL").when(warns, "WARN").otherwise("PASS")
