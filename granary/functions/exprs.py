"""Column builders over built-in functions only, so that all of them stay in generated code."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"

COMPARATORS = {"eq": operator.eq, "ge": operator.ge, "gt": operator.gt, "le": operator.le, "lt": operator.lt}
ARITHMETIC = {"plus": operator.add, "minus": operator.sub, "multiplies": operator.mul}


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def compare(op: str, left, right) -> Column:
    """``left`` and ``right``: a column name, a Column, or a constant that isn't a string."""
    return COMPARATORS[op](column(left), column(right))


def compare_either(op: str, left, first, second) -> Column:
    """True if the comparison holds with the first or with the second value."""
    return compare(op, left, first) | compare(op, left, second)


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions, F.lit(True)) if conditions else F.lit(True)


def between(x, low, high) -> Column:
    return compare("ge", x, low) & compare("le", x, high)


def arithmetic(op: str, left, right) -> Column:
    """plus, minus, multiplies; divides and modulus for integers truncate toward zero."""
    left, right = column(left), column(right)
    if op == "divides":
        return F.call_function("div", left, right)
    if op == "modulus":
        return left % right
    return ARITHMETIC[op](left, right)


def negate(x) -> Column:
    return -column(x)


def money(x) -> Column:
    """Exact two-digit decimal; also makes -0.0 plain zero."""
    return column(x).cast(MONEY)


def cents(x) -> Column:
    """Hundredths as a whole number: what ``money`` holds, in generated code over machine words."""
    return F.rint(column(x) * 100).cast("bigint")


WIDE = 1_000_000


def exact_sum(x, scale: int) -> Column:
    """Sum of whole numbers of 10^-scale as a double, exact inside.

    Two sums of machine words, of the quotients and the remainders by ``WIDE``: neither overflows below 10^12 rows of 10^12.
    """
    whole = column(x)
    high, low = F.sum(F.call_function("div", whole, F.lit(WIDE))), F.sum(whole % WIDE)
    total = high.cast("decimal(38,0)") * F.lit(WIDE).cast("decimal(7,0)") + low.cast("decimal(38,0)")
    return F.concat(total.cast("string"), F.lit(f"E-{scale}")).cast("double")


def rescale(x, precision: int, scale: int) -> Column:
    return column(x).cast(f"decimal({precision},{scale})")


def divide_keeping_scale(x, y, precision: int = 18, scale: int = 2) -> Column:
    """Fixed-point division that keeps the left scale and truncates toward zero."""
    shifted = (column(x).cast(f"decimal({precision},{scale})") * F.lit(10**scale)).cast("bigint")
    whole = F.call_function("div", shifted, column(y).cast("bigint"))
    return (whole.cast("decimal(20,0)") / F.lit(10**scale)).cast(f"decimal({precision},{scale})")


def contains(x, part: str) -> Column:
    return column(x).contains(part)


def contains_in_order(x, first: str, second: str) -> Column:
    """``first`` occurs and ``second`` occurs after its first occurrence."""
    at = F.instr(column(x), first)
    return (at > 0) & (F.locate(second, column(x), 1) > 0) & F.substr(column(x), at + len(first)).contains(second)


def starts_with(x, part: str) -> Column:
    return column(x).startswith(part)


def ends_with(x, part: str) -> Column:
    return column(x).endswith(part)


def prefix(x, n: int) -> Column:
    return F.substring(column(x), 1, n)


def first_char(x) -> Column:
    return prefix(x, 1)


def trimmed(x) -> Column:
    """Fixed-width text without its leading blanks."""
    return F.ltrim(column(x))


def year(x) -> Column:
    return F.year(column(x)).cast("int")


def julian_day(x) -> Column:
    return (F.unix_date(column(x).cast("date")) + 2440588).cast("int")


def from_julian_day(x) -> Column:
    return F.date_from_unix_date((column(x) - 2440588).cast("int"))


def moment(text: str) -> Column:
    """A time-stamp literal that compares with the raw column, so the filter reaches the scan."""
    return F.lit(text).cast("timestamp_ntz")


def row_hash(*names) -> Column:
    return F.xxhash64(*[column(n) for n in names])
