"""Number parsing and row-wise numeric helpers, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are dropped from a number's text.
DROPPED = "$, \t\n\r\f\u000b\u00a0"

MISSING = -1.0
HIDDEN = -999.0


def clean_numeric(c: Column) -> Column:
    """Text or number to double; ``$``, commas and blanks are dropped, what is left must be a number."""
    return bare_numeric(bare_text(c))


def bare_text(c: Column) -> Column:
    """The text of a number without ``$``, commas and blanks."""
    return F.translate(c.cast("string"), DROPPED, "")


def bare_numeric(bare: Column) -> Column:
    """A bare text as double. It is used several times, so inside lambdas it should be a field, not a formula.

    The JVM also reads "1d", "NaN", "Infinity" and hex floats, so the last character must be a
    digit or a point and there must be no "x". No regular expression runs per row.
    """
    plain = F.substring(bare, -1, 1).isin(list("0123456789.")) & ~F.lower(bare).contains("x")
    return F.when(plain, bare.try_cast("double"))


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Double value of a column; numeric columns are not sent through text. NaN becomes null."""
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    return clean_numeric(c)


def number_or(c: Column, default: float, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion with a default for null and unparseable values."""
    return F.coalesce(to_number(c, dtype), F.lit(float(default)))


def as_flag(c: Column, dtype: T.DataType | None = None) -> Column:
    """0/1 column from whatever an encoded column holds; 'NA' and junk become 0."""
    if isinstance(dtype, T.IntegerType):
        return F.coalesce(c, F.lit(0))
    return F.coalesce(to_number(c, dtype).cast("int"), F.lit(0))


def is_bad_number(c: Column) -> Column:
    """Null, NaN or infinite."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def row_median(cols: list[Column], ignore=(MISSING,), missing: float = MISSING) -> Column:
    """Median over several columns of one row, skipping null, NaN and the ignored values."""
    def kept(c: Column) -> Column:
        d = c.cast("double")
        return F.when(~F.isnan(d) & ~d.isin(*[float(v) for v in ignore]), d)

    values = [kept(c) for c in cols]
    # Descending order puts the nulls last; sort_array is compiled, unlike lambda-based sorts.
    ordered = F.sort_array(F.array(*values), asc=False)
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    middle = (F.get(ordered, F.shiftright(n - 1, 1)) + F.get(ordered, F.shiftright(n, 1))) / 2
    return F.when(n == 0, F.lit(float(missing))).otherwise(middle)


def below_threshold(score: Column, is_number: Column, limit: float = 600.0, value: Column | None = None) -> tuple[Column, Column]:
    """(value, flag) for a score that may be a number, a numeric text or the words "below 600".

    Only real numbers are compared with the limit, so the text "550" is not flagged. ``value`` is the
    score's number where it is known already.
    """
    value = clean_numeric(score) if value is None else value
    words = F.lower(F.trim(score)) == F.lit(f"below {int(limit)}")
    named = F.coalesce(~is_number & words, F.lit(False))
    small = F.coalesce(is_number & (value < limit), F.lit(False))
    number = F.when(named, F.lit(limit - 1)).otherwise(value)
    return number, F.when(named | small, 1).otherwise(0)


def found_number(c: Column, kind: str = "int") -> Column:
    """What a regular expression found, as a number; nothing found is null.

    Spark raises and catches an exception for a text that is no number, and nothing is found on
    most lines, so the empty text never gets as far as the cast.
    """
    return F.nullif(c, F.lit("")).try_cast(kind)


def money(c: Column) -> Column:
    """First ``$n,nnn`` in a text as bigint."""
    return found_number(F.regexp_replace(F.regexp_extract(c, r"\$([0-9,]+)", 1), ",", ""), "bigint")


def percent(c: Column) -> Column:
    """First ``nn%`` in a text as int."""
    return found_number(F.regexp_extract(c, r"(\d{1,3})%", 1))


def standalone_score(c: Column) -> Column:
    """The text as int when it is a bare 3- or 4-digit number."""
    return F.when(c.rlike(r"^\d{3,4}$"), c.try_cast("int"))


def per_month(c: Column) -> Column:
    """``$n,nnn/mo`` at the start of a text as bigint."""
    return F.when(c.rlike(r"^\$[0-9,]+/mo"), found_number(F.regexp_replace(c, r"[^0-9]", ""), "bigint"))
