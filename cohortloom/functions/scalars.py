"""Scalar expressions on claims codes, dates and probabilities. NULL in, NULL out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(c: Column) -> Column:
    """Upper case without quotes, dots and outer blanks; tokens for missing values become NULL."""
    x = F.upper(F.trim(F.regexp_replace(c, r"['\".]", "")))
    return F.when(x.isin("", "NAN", "NONE", "NULL"), F.lit(None)).otherwise(x)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strip_zeros(c: Column) -> Column:
    """Leading zeros off; a code of zeros only is '0'."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0"))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def parse_day(c: Column) -> Column:
    """yyyymmdd text, also with a float suffix; invalid days are NULL."""
    return F.try_to_date(F.split(c, r"\.")[0], "yyyyMMdd")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def above(c: Column, threshold: Column) -> Column:
    """1 where strictly above, else 0, also for NULL."""
    return F.coalesce((c > threshold).cast("int"), F.lit(0))


def died(status: Column, code: str = "20") -> Column:
    return F.coalesce((F.trim(status) == code).cast("int"), F.lit(0))


def entropy(p: Column) -> Column:
    """Binary entropy in bits."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def map_values(c: Column, values: dict[str, str]) -> Column:
    """Mapped value, or the value itself where it has none."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c)


def outcome_lift(pos: Column, n: Column, base: Column) -> Column:
    """min(1/base, max(p/base, base/p)) with p = pos/n; 1/base for p = 0, 1 for n = 0; base is at least .0001."""
    floor = F.greatest(base, F.lit(1e-4))
    p = pos / n
    return F.when(n == 0, F.lit(1.0)).when(pos == 0, 1 / floor).otherwise(F.least(1 / floor, F.greatest(p / floor, floor / p)))


def chi2(n11: Column, n1: Column, n_1: Column, n: Column) -> Column:
    """Chi-square of a 2x2 table from its joint count, margins and total, without correction; NULL if any cell is 0."""
    n11, n1, n_1, n = (x.cast("double") for x in (n11, n1, n_1, n))  # products of counts overflow a long
    a, b, c = n11, n1 - n11, n_1 - n11
    d = n - n1 - n_1 + n11
    value = n * (a * d - b * c) * (a * d - b * c) / (n1 * (n - n1) * n_1 * (n - n_1))
    return F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), value)


def order_expectation(days: Column) -> Column:
    """Expected strict-order score of days after random tie-breaks: 0 if any day is before its predecessor, else the product of 1/size! over
    groups of equal days."""
    pairs = F.zip_with(F.slice(days, 1, F.size(days) - 1), F.slice(days, F.lit(2), F.size(days) - 1), lambda a, b: a <= b)
    ties = F.transform(F.array_distinct(days), lambda d: F.factorial(F.size(F.filter(days, lambda x: x == d))).cast("double"))
    return F.when(F.forall(pairs, lambda x: x), 1 / F.aggregate(ties, F.lit(1.0), lambda p, x: p * x)).otherwise(0.0)
