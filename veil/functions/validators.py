"""Scalar checks and parsers of candidate values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import MONTHS
from .text import digits_of, let


def luhn_valid(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def card_scheme_match(digits: Column) -> Column:
    """Prefix and length of a card scheme; the first prefix that fits decides."""
    # Prefixes and lengths.
    n = F.length(digits)
    two, three = F.substring(digits, 1, 2), F.substring(digits, 1, 3)
    four = F.when(n >= 4, F.substring(digits, 1, 4).try_cast("int"))
    return (
        F.when(~digits.rlike(r"^\d+$"), False)
        .when(F.substring(digits, 1, 1) == "4", n.isin(13, 16, 19))
        .when(two.isin("51", "52", "53", "54", "55"), n == 16)
        .when(four.between(2221, 2720), n == 16)
        .when(two.isin("34", "37"), n == 15)
        .when((F.substring(digits, 1, 4) == "6011") | (two == "65") | three.isin("644", "645", "646", "647", "648", "649"), n == 16)
        .when(three.isin("300", "301", "302", "303", "304", "305") | two.isin("36", "38"), n == 14)
        .when(four.between(3528, 3589), n == 16)
        .otherwise(False)
    )


def card_brand(value: Column) -> Column:
    # Prefixes and lengths.
    d = digits_of(value)
    two = F.substring(d, 1, 2)
    return (
        F.when(F.substring(d, 1, 1) == "4", "visa")
        .when(two.isin("51", "52", "53", "54", "55") | ((F.length(d) >= 4) & F.substring(d, 1, 4).try_cast("int").between(2221, 2720)), "mastercard")
        .when(two.isin("34", "37"), "amex")
        .when((F.substring(d, 1, 4) == "6011") | two.isin("65", "64"), "discover")
        .otherwise("unknown")
    )


def ssn_valid(value: Column) -> Column:
    part = lambda d, a, n: F.coalesce(F.substring(d, a, n).try_cast("int"), F.lit(0))
    area = lambda a: (a > 0) & (a != 666) & (a < 900)
    return let(digits_of(value), lambda d: (F.length(d) == 9) & area(part(d, 1, 3)) & (part(d, 4, 2) > 0) & (part(d, 6, 4) > 0))


def calendar(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none; year 0 is none."""
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.lpad(year, 4, "0") != "0000", F.try_to_date(iso, "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    """Number, as a string, of a month's full name or its first three letters."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(low.isin(m, m[:3]), F.lit(str(i))).otherwise(out)
    return out


def parse_date(value: Column) -> Column:
    """The calendar date that a value names, day before month where both can be."""
    v = F.trim(value)
    pick = lambda p, n: F.regexp_extract(v, p, n)
    four = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"
    two = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    day_first = r"(?U)^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    month_first = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    short = F.concat(F.when(pick(two, 3) >= "69", "19").otherwise("20"), pick(two, 3))
    return (
        F.when(v.rlike(four), F.coalesce(calendar(pick(four, 4), pick(four, 3), pick(four, 1)), calendar(pick(four, 4), pick(four, 1), pick(four, 3))))
        .when(v.rlike(two), F.coalesce(calendar(short, pick(two, 2), pick(two, 1)), calendar(short, pick(two, 1), pick(two, 2))))
        .when(v.rlike(iso), calendar(pick(iso, 1), pick(iso, 2), pick(iso, 3)))
        .when(v.rlike(day_first), calendar(pick(day_first, 3), month_number(pick(day_first, 2)), pick(day_first, 1)))
        .when(v.rlike(month_first), calendar(pick(month_first, 3), month_number(pick(month_first, 1)), pick(month_first, 2)))
    )


def plausible_birth(date: Column, as_of: Column) -> Column:
    """Whole years from 0 to 120 at as_of, and born in 1900 or later."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(date) * 100 + F.dayofmonth(date))
    age = F.year(as_of) - F.year(date) - before.cast("int")
    return F.coalesce(age.between(0, 120) & (F.year(date) >= 1900), F.lit(False))


def ip_valid(value: Column) -> Column:
    """A dotted quad without leading zeros or an IPv6 address, and not the unspecified one."""
    octets = F.split(value, r"\.")
    quad = (F.size(octets) == 4) & F.forall(octets, lambda o: o.rlike(r"^(?:0|[1-9]\d{0,2})$") & (o.try_cast("int") <= 255))
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    short = F.size(F.split(value, "::", -1)) == 2
    loose = value.rlike("^:[^:]") | value.rlike("[^:]:$") | F.contains(value, F.lit(":::"))
    six = value.rlike("^[0-9A-Fa-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4) & ~loose & F.when(short, F.size(groups) <= 7).otherwise((F.size(groups) == 8) & ~F.contains(value, F.lit("::")))
    return F.when(F.contains(value, F.lit(":")), six & value.rlike("[1-9A-Fa-f]")).otherwise(quad & value.rlike("[1-9]"))
