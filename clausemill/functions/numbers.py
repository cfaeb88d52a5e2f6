"""Number, date and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column | str, share: float) -> Column:
    """Of an array of values the one at position floor(n * share) of the sorted values, the last at most."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return F.when(n > 0, F.try_element_at(ordered, F.greatest(F.lit(1), F.least(F.floor(n * F.lit(share)).cast("int"), n - 1) + 1).cast("int")))


def two_form_date(c: Column | str) -> Column:
    """A date written year-first with hyphens or day-first with slashes; null otherwise."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"))


def process_digits(c: Column | str) -> Column:
    """The digits of a process number, null unless there are 17."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 17, d)


def process_formatted(c: Column | str) -> Column:
    d = process_digits(c)
    return F.when(d.isNotNull(), F.concat(F.substring(d, 1, 5), F.lit("."), F.substring(d, 6, 6), F.lit("/"), F.substring(d, 12, 4), F.lit("-"), F.substring(d, 16, 2)))


def cnpj_digits(c: Column | str) -> Column:
    """14 digits, a lost leading zero restored; null if there are fewer than 13."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d).isin(13, 14), F.lpad(d, 14, "0"))


def cnpj_formatted(c: Column | str) -> Column:
    """The punctuated form; null without 13 or 14 digits."""
    d = cnpj_digits(c)
    part = lambda start, n: F.substring(d, start, n)
    return F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))


def _mod11(digits: Column, weights: list[int]) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, F.lit("0")).otherwise((11 - rest).cast("string"))


def cnpj_valid(c: Column | str) -> Column:
    """Whether both check digits of a CNPJ fit; null without 13 or 14 digits."""
    weights = [*range(5, 1, -1), *range(9, 1, -1)]
    d = cnpj_digits(c)
    first = _mod11(F.substring(d, 1, 12), weights)
    second = _mod11(F.concat(F.substring(d, 1, 12), first), [6, *weights])
    return F.substring(d, 13, 2) == F.concat(first, second)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def era(year: Column | str) -> Column:
    """Filing years in four eras."""
    y = F.try_to_number(year, F.lit("9999")).cast("int") if isinstance(year, str) else year.cast("int")
    return F.when(y <= 2010, "until_2010").when(y <= 2015, "2011_2015").when(y <= 2020, "2016_2020").when(y.isNotNull(), "from_2021")
