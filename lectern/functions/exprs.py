"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_SECONDS = 86400

# Tried in this order after ISO 8601; month first, where day and month are ambiguous.
TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy hh:mm a",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int) -> Column:
    """Half-even rounding of the scaled double, as numpy and pandas round."""
    scale = float(10**digits)
    return F.rint(_col(c).cast("double") * scale) / scale


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a number; null stays null."""
    value = _col(c)
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed whole 24-hour days (floored), not calendar days."""
    micros = F.unix_micros(_col(later).cast("timestamp")) - F.unix_micros(_col(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(DAY_SECONDS * 1_000_000.0))


def yes_no(c: str | Column) -> Column:
    """Yes/No/True/False to boolean; anything else, null included, is false."""
    return F.coalesce(_col(c).cast("string").isin("Yes", "yes", "True", "true"), F.lit(False))


def number(c: str | Column, default: float | None = None) -> Column:
    """Numeric coercion: text that does not parse, and NaN, become null or `default`."""
    text = F.trim(_col(c).cast("string"))
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    value = F.when(F.isnan(value), None).otherwise(value)
    return value if default is None else F.coalesce(value, F.lit(default))


WHOLE = r"^[+-]?\d+$"


def whole_number(c: str | Column) -> Column:
    """The text as a 64 bit whole number; null if it has a fraction, an exponent or more digits than fit."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def numeric(df: DataFrame, name: str, default: float | None = None) -> Column:
    """`number` for a column that may already be numeric."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        value = F.when(F.isnan(value), None).otherwise(value)
        return value if default is None else F.coalesce(value, F.lit(default))
    return number(name, default)


# How dates are written with names of months, and what may follow a date.
_MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?"
_CLOCK = r"(?:(?:t|,? +(?:at +)?)(\d{1,2})(?::(\d{2}))?(?::(\d{2})(\.\d{1,6})?\d*)? *([ap])?(?:\.?m\.?)? *(z|utc|gmt|[+-]\d{2}:?\d{2})?)?$"
#: Patterns of lower-case texts with the groups that hold year, month and day; the groups of a time follow them.
DATE_FORMS = (
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?(?: of)?[ -]+({_MONTHS})\.?,?[ -]+(\d{{4}}){_CLOCK}", (3, 2, 1)),
    (rf"^{_WEEKDAY}({_MONTHS})\.?[ -]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ -]+(\d{{4}}){_CLOCK}", (3, 1, 2)),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}", (1, 2, 3)),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_CLOCK}", (3, 1, 2)),
    (r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2})(\d{2})(\d{2})?(\.\d{1,6})?()(z)?)?$", (1, 2, 3)),
)


def _date_form(low: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    """The time that a pattern finds: month and day change places if only that makes a date; a lone hour needs am or pm."""
    part = lambda i: F.regexp_extract(low, pattern, i)
    year, month, day = (part(i) for i in places)
    named = F.floor((F.position(F.substring(month, 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)
    month = F.when(month.rlike("^[a-z]"), named).otherwise(month.try_cast("int"))
    day = day.try_cast("int")
    swap = (month > 12) & (day <= 12) if places == (3, 1, 2) else F.lit(False)
    month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
    hour, minute, second, half = part(4).try_cast("int"), part(5), part(6), part(8)
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    filled = lambda x: F.when(x == "", "00").otherwise(x)
    zone = F.when(part(9).rlike("^[zug]"), "Z").otherwise(F.regexp_replace(part(9), r"^(...)(\d\d)$", "$1:$2"))
    clock = F.concat(F.lit(" "), F.coalesce(two(hour), F.lit("00")), F.lit(":"), filled(minute), F.lit(":"), filled(second), part(7), zone)
    found = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), clock).try_cast("timestamp")
    lone = (part(4) != "") & (minute == "") & (half == "")
    return F.when(low.rlike(pattern) & ~lone, found)


def timestamp(c: str | Column, formats: Iterable[str] = TIMESTAMP_FORMATS) -> Column:
    """Timestamp coercion: ISO 8601 with optional fraction and offset, then an ordered list of formats; failures become null.

    With the default list, dates with names of months, day before month where the month would be above 12, dots, compact digits and
    offsets are tried last.
    """
    text = F.trim(_col(c).cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    # in a lambda, so that what few rows need does not swell the code that is generated for all
    forms = F.transform(F.array(F.lower(text)), lambda low: F.coalesce(*[_date_form(low, *form) for form in DATE_FORMS]))
    free = [F.get(forms, F.lit(0))] if tuple(formats) == TIMESTAMP_FORMATS else []
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats], *free)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """`timestamp` for a column that may already be one."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return timestamp(name)


def true_or_false(cond: Column) -> Column:
    """A comparison with a missing operand is false, not null."""
    return F.coalesce(cond, F.lit(False))


def total(c: str | Column) -> Column:
    """Sum that is 0 for a group of nulls."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def flag_sum(c: str | Column) -> Column:
    """Number of true values."""
    return F.count_if(F.coalesce(_col(c).cast("boolean"), F.lit(False)))


def flag_mean(c: str | Column) -> Column:
    """Share of true values among the non-null ones."""
    return F.avg(_col(c).cast("boolean").cast("int"))


def right_closed_bins(c: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Bins (a, b], the first one closed on both sides; null outside."""
    value = _col(c)
    out = F.when(value < edges[0], None)
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, F.lit(label))
    return out


def significance_text(p: str | Column, digits: int) -> Column:
    """p-value text with *** below 0.001, ** below 0.01 and * below 0.05."""
    value = _col(p)
    stars = F.when(value < 0.001, "***").when(value < 0.01, "**").when(value < 0.05, "*").otherwise("")
    return F.concat(F.format_string(f"%.{digits}f", rounded(value, digits)), stars)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def clean_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("(%)", "pct")


def q(name: str) -> str:
    """Quote a column name that may hold dots, blanks or brackets."""
    return "`" + name.replace("`", "``") + "`"
