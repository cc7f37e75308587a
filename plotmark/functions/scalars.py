"""Column expressions: keys, text, numbers and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

DAY_ZERO = "1960-01-01"
# Fixed value: 45 years of 365 days after day zero, i.e. 2004-12-20 (rule Q10).
SALES_FROM_DAY = 16425

# Build quality grade to rank.
QUALITY_RANK = {
    "A+": 1, "A": 2, "A-": 3,
    "B+": 4, "B": 5, "B-": 6,
    "C+": 7, "C": 8, "C-": 9,
    "D+": 10, "D": 11, "D-": 12,
    "F": 13, "E+": 13, "E": 13, "E-": 13,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer text stays whole (``lpad`` alone would cut it)."""
    c = col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def first_part(c: Column | str, *separators: str) -> Column:
    """Text before the first of the separators."""
    c = col(c)
    for s in separators:
        c = F.split_part(c, F.lit(s), F.lit(1))
    return c


def clean_zip(c: Column | str) -> Column:
    return zero_pad(first_part(col(c).cast("string"), "-", "."), 5)


def gisjoin_county(county: Column | str) -> Column:
    """``G`` + state + ``0`` + county + ``0`` from a five-digit county code."""
    c = col(county)
    return F.concat(F.lit("G"), F.substring(c, 1, 2), F.lit("0"), F.substring(c, 3, 1_000), F.lit("0"))


def gisjoin_state(county: Column | str) -> Column:
    return F.concat(F.lit("G"), F.substring(col(county), 1, 2))


def blockgroup_id(tract_and_block: Column | str) -> Column:
    """State, county and tract (characters 1-9) and block group (11-13)."""
    c = col(tract_and_block)
    return F.concat(F.substring(c, 1, 9), F.substring(c, 11, 3))


def blockgroup_from_gisjoin(gisjoin: Column | str) -> Column:
    c = col(gisjoin)
    return F.concat(F.substring(c, 2, 2), F.substring(c, 5, 3), F.substring(c, 9, 4), F.substring(c, 13, 3))


def metro_city(name: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    """First city of a metro name such as ``A-B, TX-OK``."""
    c = F.regexp_replace(F.regexp_replace(col(name), ",.*$", ""), "-.*$", "")
    for old, new in (aliases or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def metro_state(name: Column | str) -> Column:
    """First state of a metro name such as ``A-B, TX-OK Metro Area``."""
    c = F.regexp_replace(col(name), ".*, ", "")
    return F.regexp_replace(F.regexp_replace(c, " .*$", ""), "-.*$", "")


def split_metro_name(name: Column | str, aliases: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    return metro_city(name, aliases), metro_state(name)


def map_values(c: Column | str, mapping: Mapping[str, int]) -> Column:
    """Value lookup; values outside the mapping become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def top_code(c: Column | str, cap: float) -> Column:
    """Cap a value; null stays null."""
    c = col(c)
    return F.when(c >= cap, F.lit(cap)).otherwise(c)


def ratio_in_range(num: Column | str, den: Column | str, lo: float, hi: float) -> Column:
    """Ratio, null when undefined or outside ``[lo, hi]`` (rules Q5, Q7)."""
    ratio = F.try_divide(col(num), col(den))
    return F.when(ratio.between(lo, hi), ratio)


def keep_in_range(c: Column | str, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.between(lo, hi), c)


def age_at(event_year: Column | str, built_year: Column | str) -> Column:
    """Years since building; null for an event before it."""
    age = col(event_year) - col(built_year)
    return F.when(age >= 0, age)


def day_number(date: Column | str) -> Column:
    """Days since 1960-01-01; text that is no date becomes null."""
    return F.datediff(F.try_to_date(col(date).cast("string")), F.to_date(F.lit(DAY_ZERO)))


def date_from_day(day: Column | str) -> Column:
    return F.date_add(F.to_date(F.lit(DAY_ZERO)), col(day).cast("int"))


def month_index(date: Column | str) -> Column:
    """Months since January 1960."""
    d = col(date)
    return (F.year(d) - 1960) * 12 + F.month(d) - 1


def percent(c: Column | str) -> Column:
    """Share in whole percent, half to even."""
    return F.bround(col(c), 2) * 100


def log_plus_one(c: Column | str) -> Column:
    return F.log1p(col(c))


def log_per_capita(total: Column | str, population: Column | str, per: float = 100_000.0) -> Column:
    """Log of an amount per ``per`` residents (P22); null when undefined."""
    rate = F.try_divide(col(total), col(population) / per)
    return F.when(rate > 0, F.log(rate))


def not_in(c: Column | str, values: Sequence) -> Column:
    """Negated membership in which a missing value passes."""
    return F.coalesce(~col(c).isin(*values), F.lit(True))


def present(c: Column | str) -> Column:
    return col(c).isNotNull().cast("int")


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def category(c: Column | str, groups: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """Named category for each list of codes, ``other`` for the rest and for null."""
    out = None
    for name, codes in groups.items():
        test = col(c).isin(*codes)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)
