"""Label, mapping and one-hot expressions driven by literal maps."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal tier code to tier name.
TIER_NAMES = {
    "0.045": "A - Tier 1 VIP",
    "0.095": "A - Tier 1",
    "0.12": "B - Tier 1 Prime",
    "0.165": "A - Tier 1 Low APR",
    "0.24": "A - Tier 2",
    "0.31": "A - Tier 2 Low APR",
    "0.34": "A - Tier 3",
    "0.41": "A - Tier 3 Low APR",
    "0.44": "A - Tier 4",
    "0.51": "A - Tier 4 Low APR",
}

_NUMERIC = (T.NumericType, T.DecimalType)


def lookup(c: Column, mapping: dict[str, str], dtype: T.DataType | None = None) -> Column:
    """Literal-map lookup. Numeric columns are compared as numbers, never as text."""
    numeric = isinstance(dtype, _NUMERIC)
    pairs = {}
    for key, value in mapping.items():
        if numeric:
            try:
                pairs[float(key)] = str(value)
            except ValueError:
                continue
        else:
            pairs[key] = str(value)
    if not pairs:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(table, c.cast("double" if numeric else "string"))


def map_label(c: Column, labels: dict[str, str], dtype: T.DataType | None = None, other: int = -1) -> Column:
    """Integer label of a raw value; -1 (or ``other``) where the value is unknown."""
    return F.coalesce(lookup(c, labels, dtype).try_cast("int"), F.lit(other))


def map_value(c: Column, mapping: dict[str, str], dtype: T.DataType | None = None) -> Column:
    """Mapped text of a raw value; 'NA' where the value is unknown."""
    return F.coalesce(lookup(c, mapping, dtype), F.lit("NA"))


def tier_name(c: Column, dtype: T.DataType | None = None) -> Column:
    return lookup(c, TIER_NAMES, dtype)


def one_hot(c: Column, raw: str) -> Column:
    """1 where the column's text equals the raw value, else 0 (null gives 0)."""
    return F.coalesce((c.cast("string") == F.lit(str(raw))).cast("int"), F.lit(0))


def vector_to_label(arr: Column) -> Column:
    """Class index of a one-hot or probability row; null for anything else.

    A row of zeros and ones must hold exactly one 1; other rows must sum to one.
    """
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double"))
    binary = F.forall(arr, lambda x: (x == 0) | (x == 1))
    ok = F.when(binary, total == 1).otherwise(F.abs(total - 1) < 1e-8)
    return F.when(ok, (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))


def status_name(prediction: Column) -> Column:
    return F.when(prediction == 0, "approved").otherwise("declined")


def tier_text(tier: Column) -> Column:
    """Tier ids 0..3 are named 'Tier 1'..'Tier 4'; larger ids keep their own number."""
    t = tier.cast("int")
    return F.concat(F.lit("Tier "), F.when(t < 4, t + 1).otherwise(t).cast("string"))


# Raw names and their clean form. Two offers have no entry for a missing score, so
# those names are only cleaned of special characters.
NAME_RENAMES = {
    "Automatic Financing": "AutomaticFinancing",
    "0% Unsecured Funding": "0UnsecuredFunding",
    "Debt Resolution": "DebtResolution",
    "Automatic Financing_missing?": "AutomaticFinancing_missing?",
    "Automatic Financing_Score": "AutomaticFinancing_Score",
    "Automatic Financing_below_600?": "AutomaticFinancing_below_600_",
    "Automatic Financing_Status": "AutomaticFinancing_Status",
    "Automatic Financing_Amount": "AutomaticFinancing_Amount",
    "Automatic Financing_DebtToIncome": "AutomaticFinancing_DebtToIncome",
    "Automatic Financing_Details": "AutomaticFinancing_Details",
    "Automatic Financing_Contingencies": "AutomaticFinancing_Contingencies",
    "0% Unsecured Funding_missing?": "0UnsecuredFunding_missing_",
    "0% Unsecured Funding_Score": "0UnsecuredFunding_Score",
    "0% Unsecured Funding_below_600?": "0UnsecuredFunding_below_600_",
    "0% Unsecured Funding_Status": "0UnsecuredFunding_Status",
    "0% Unsecured Funding_Amount": "0UnsecuredFunding_Amount",
    "0% Unsecured Funding_DebtToIncome": "0UnsecuredFunding_DebtToIncome",
    "0% Unsecured Funding_Details": "0UnsecuredFunding_Details",
    "0% Unsecured Funding_Contingencies": "0UnsecuredFunding_Contingencies",
    "Debt Resolution_missing?": "DebtResolution_missing_",
    "Debt Resolution_Score": "DebtResolution_Score",
    "Debt Resolution_below_600?": "DebtResolution_below_600_",
    "Debt Resolution_Status": "DebtResolution_Status",
    "Debt Resolution_Amount": "DebtResolution_Amount",
    "Debt Resolution_DebtToIncome": "DebtResolution_DebtToIncome",
    "Debt Resolution_Details": "DebtResolution_Details",
    "Debt Resolution_Contingencies": "DebtResolution_Contingencies",
    "Debt Resolution_score_missing?": "DebtResolution_score_missing_",
}


def sanitize_name(name: str) -> str:
    """Driver-side column-name cleaning: known renames, then ``[^A-Za-z0-9_]`` to ``_``."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", NAME_RENAMES.get(name, name))


def sanitize_value(c: Column) -> Column:
    """The same cleaning for names held as data."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(NAME_RENAMES.items())])
    return F.regexp_replace(F.coalesce(F.try_element_at(table, c), c), r"[^a-zA-Z0-9_]", "_")
