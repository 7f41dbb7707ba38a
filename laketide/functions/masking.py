"""Masks as column expressions; the caller's role is always an explicit argument."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import col

# Mask fragments and income bands.
LAST_DIGITS_PREFIX = "*****"
IBAN_FILLER = "****"
EMAIL_FILLER = "***@"
INCOME_BANDS = ((30000, "< 30k"), (70000, "30k–70k"))
TOP_INCOME_BAND = "70k+"


def keep_last(c: str | Column, n: int = 4, prefix: str = LAST_DIGITS_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.right(col(c), F.lit(n)))


def keep_ends(c: str | Column, head: int = 2, tail: int = 4, filler: str = IBAN_FILLER) -> Column:
    return F.concat(F.left(col(c), F.lit(head)), F.lit(filler), F.right(col(c), F.lit(tail)))


def email(c: str | Column) -> Column:
    return F.concat(F.left(col(c), F.lit(1)), F.lit(EMAIL_FILLER), F.split_part(col(c), F.lit("@"), F.lit(2)))


def initial_and_last_name(c: str | Column) -> Column:
    """First letter of the first word, then the second word (empty when there is none)."""
    first = F.split_part(col(c), F.lit(" "), F.lit(1))
    second = F.split_part(col(c), F.lit(" "), F.lit(2))
    return F.concat(F.left(first, F.lit(1)), F.lit(". "), second)


def first_letter_only(c: str | Column) -> Column:
    return F.concat(F.left(col(c), F.lit(1)), F.lit("***"))


def income_band(c: str | Column, bands: Sequence[tuple] = INCOME_BANDS, top: str = TOP_INCOME_BAND) -> Column:
    result = F.lit(top)
    for limit, label in reversed(list(bands)):
        result = F.when(col(c) < limit, F.lit(label)).otherwise(result)
    return F.when(col(c).isNotNull(), result)


def token(c: str | Column, salt: str = "") -> Column:
    """Deterministic pseudonym; equal values keep equal tokens, so joins still work."""
    text = col(c).cast("string")
    return F.sha2(F.concat(text, F.lit(salt)) if salt else text, 256)


MASKS = {
    "show_last_4": keep_last,
    "first_letter_only": first_letter_only,
    "keep_ends": keep_ends,
    "email": email,
    "income_band": income_band,
    "token": token,
}


def mask_by_contract(df: DataFrame, masking: Mapping[str, str], clear: bool = False) -> DataFrame:
    """Mask the columns a contract lists; ``clear=True`` is the entitled reader's view."""
    if clear:
        return df
    unknown = set(masking.values()) - set(MASKS)
    if unknown:
        raise ValueError(f"unknown mask: {sorted(unknown)}")
    return df.withColumns({c: MASKS[kind](c) for c, kind in masking.items()})
