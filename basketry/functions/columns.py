"""Column expressions that several models share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
#: Stands for NULL inside a surrogate key; fixed value.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def surrogate_key(*cols: str) -> Column:
    return F.md5(F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)) for c in cols)))


def clean(c: str, lower: bool = False, default: str | None = None) -> Column:
    """Trimmed, empty as null, then lower case and a default if wanted."""
    x = F.nullif(F.trim(F.col(c)), F.lit(""))
    x = F.lower(x) if lower else x
    return x if default is None else F.coalesce(x, F.lit(default))


def ladder(c: Column, steps: list[tuple], other: str) -> Column:
    """The label of the first step whose bound c does not exceed."""
    return reduce(lambda x, s: F.when(c <= s[0], s[1]).otherwise(x), reversed(steps), F.lit(other))


def ratio_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def mean(total: Column, n: Column, digits: int = 2) -> Column:
    """A rounded mean of a decimal sum. The last step rounds to a whole number, where a tie is exact, so engines agree; none of nothing."""
    return F.round(F.try_divide((total * 10**digits).cast("double"), n)) / 10**digits


def fiscal_year(d: Column) -> Column:
    """Years that start on 1 February."""
    return F.when(F.month(d) >= 2, F.year(d)).otherwise(F.year(d) - 1)


def fiscal_quarter(d: Column) -> Column:
    return (F.floor(((F.month(d) + 10) % 12) / 3) + 1).cast("int")


def category(c: str) -> Column:
    """What stands before the first colon."""
    return F.split(F.col(c), ":")[0]
