"""Column builders for cleaning, parsing and exact arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The id format and the two date formats that source files use.
ID_PATTERN = r"^\d{9}$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column, scale: int = 2) -> Column:
    """Exact decimal, so that sums do not depend on the order of addition."""
    return col(c).cast(f"decimal(18,{scale})")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


def mean(c: str | Column) -> Column:
    """Average from an exact sum; NULL for an empty group."""
    return F.try_divide(total(c), F.count(col(c)))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def nine_digit_id(c: str | Column) -> Column:
    return F.lpad(col(c).cast("string"), 9, "0")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def normalize_category(c: str | Column, allowed: Sequence[str], default: str = "UNKNOWN") -> Column:
    """Keep a value of the domain, map everything else (NULL too) to ``default``."""
    return F.when(col(c).isin(*allowed), col(c)).otherwise(F.lit(default))


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses, else NULL; never raises under ANSI mode."""
    return F.coalesce(*[F.try_to_date(col(c), f) for f in formats])


def first_reason(checks: Mapping[str, Column]) -> Column:
    """Name of the first condition that holds, NULL when none does."""
    result = F.lit(None).cast("string")
    for name, condition in reversed(list(checks.items())):
        result = F.when(condition, F.lit(name)).otherwise(result)
    return result


def row_fingerprint(columns: Sequence[str], missing: str = "\u0000") -> Column:
    """SHA-256 over all fields; NULL takes a place of its own, so a shift between
    neighbouring fields changes the value."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]
    return F.sha2(F.concat_ws("||", *parts), 256)


def bucket_by_bounds(c: str | Column, bounds: Sequence[float]) -> Column:
    """Number of bounds that are <= the value; NULL, which sorts first, gets 0.

    A binary search over one array literal: its expression stays small for any number of
    bounds, where a CASE with a branch per bound would outgrow the code generator.
    """
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    table = F.lit([float(b) for b in sorted(bounds)] + [float("inf")] * (size - 1 - len(bounds)))
    steps = F.lit([size >> i for i in range(1, size.bit_length())])
    value = col(c).cast("double")

    def narrow(found: Column, step: Column) -> Column:
        return F.when(value >= F.element_at(table, found + step), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), narrow)
