"""Scalar column expressions shared by the reports (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schemas as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    """TIMESTAMP_NTZ literal (wall clock, no session-zone conversion)."""
    return F.lit(str(text)).cast("timestamp_ntz")


def now_wall_clock() -> Column:
    """The query's (or micro-batch's) current time as a UTC wall-clock
    TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()), ntz("1970-01-01 00:00:00"))


def days_before(ts: Column, days: int) -> Column:
    """``ts - n days`` on a TIMESTAMP_NTZ (calendar days, like AddDate)."""
    return F.timestamp_add("DAY", F.lit(-int(days)), ts)


def in_range(c, start: Column, end: Column) -> Column:
    """Half-open ``[start, end)``."""
    c = col(c)
    return (c >= start) & (c < end)


PARTITION_DATE = "event_date"


def time_window(df, c: str, start: Column, end: Column):
    """``df`` rows with ``c`` in [start, end). When the table is stored
    partitioned by day (``event_date``), the same range is also put on the
    partition column so the scan skips whole days (partition pruning); the
    exact filter on ``c`` still applies inside the kept days."""
    out = df.filter(in_range(c, start, end))
    if PARTITION_DATE in df.columns:
        out = out.filter((F.col(PARTITION_DATE) >= F.to_date(start)) & (F.col(PARTITION_DATE) <= F.to_date(end)))
    return out


def is_impression(c="event_type") -> Column:
    return col(c).isin(*S.IMPRESSION_EVENTS)


def is_click(c="event_type") -> Column:
    return col(c).isin(*S.CLICK_EVENTS)


def is_engagement(c="event_type") -> Column:
    return col(c).isin(*S.ENGAGEMENT_EVENTS)


def is_recommendation_event(c="event_type") -> Column:
    return col(c).startswith(S.RECOMMENDATION_PREFIX)


def count_if(cond: Column) -> Column:
    """``COUNT(*) FILTER (WHERE cond)``; bigint, 0 on empty input."""
    return F.count(F.when(cond, F.lit(1)))


def non_empty(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


def pct_rate(num, den) -> Column:
    """Percentage with two decimals, 0 when the denominator is 0.
    Rounds half away from zero like the reference."""
    num, den = col(num), col(den)
    return (F.when(den == 0, F.lit(0.0))
            .otherwise(F.round(F.try_divide(num.cast("double"), den.cast("double")) * 10000, 0) / 100))


def change_rate(now, last) -> Column:
    """Week-over-week change in percent: 0 -> 0 stays 0, 0 -> x is 100."""
    now, last = col(now).cast("double"), col(last).cast("double")
    return (F.when(last == 0, F.when(now == 0, F.lit(0.0)).otherwise(F.lit(100.0)))
            .otherwise(F.round(F.try_divide(now - last, last) * 10000, 0) / 100))


def fraction(num, den) -> Column:
    """Plain fraction guarded by ``den > 0`` (else 0.0), unrounded."""
    num, den = col(num), col(den)
    return F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))).otherwise(F.lit(0.0))


def normalize_name(c) -> Column:
    """lower(replace(name, '_', ' ')): segment-name comparison key."""
    return F.lower(F.replace(col(c), F.lit("_"), F.lit(" ")))


def normalize_feature(c) -> Column:
    """strip, lower, '-' and ' ' to '_'; NULL to ''."""
    stripped = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    return F.translate(F.lower(stripped), "- ", "__")


def contains_any(c, needles: Iterable[str]) -> Column:
    c = col(c)
    out = None
    for n in needles:
        term = F.contains(c, F.lit(n))
        out = term if out is None else (out | term)
    return out


def ratio4(num, den) -> Column:
    """round(num/den, 4) half-to-even, 0 when den <= 0."""
    num, den = col(num), col(den)
    return F.when(den > 0, F.bround(F.try_divide(num.cast("double"), den.cast("double")), 4)).otherwise(F.lit(0.0))


def week_monday(ts: Column) -> Column:
    """Monday 00:00 of the week of ``ts`` (Sunday belongs to the week before)."""
    return F.date_trunc("week", ts)


def fmt_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def period_text(start: Column, end: Column, sep: str = " to ") -> Column:
    return F.concat(fmt_date(start), F.lit(sep), fmt_date(end))


def weekday_label(index0: Column) -> Column:
    """0 = Monday ... 6 = Sunday -> Senin ... Minggu."""
    return F.element_at(F.array(*[F.lit(x) for x in S.WEEKDAY_LABELS]), (index0 + 1).cast("int"))


def customer_code(id_col) -> Column:
    return F.format_string(S.CUSTOMER_ID_FORMAT, col(id_col))


def days_between_floor(later: Column, earlier: Column) -> Column:
    """floor((later - earlier) / 1 day) on NTZ timestamps, session-zone independent."""
    secs = F.timestamp_diff("SECOND", earlier, later)
    return F.floor(secs / F.lit(86400))


def valid_json(c: str | Column) -> Column:
    """Whether a text is exactly one JSON value: repeated keys are allowed, text after
    the value is not.

    The reader of arrays stops at the end of the array, so the text is read as the only
    item of one array and as the first of two: a text that closes the array itself
    gives both the same length.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    text = F.col(c) if isinstance(c, str) else c

    def items(tail: str) -> Column:
        return F.size(F.from_json(F.concat(F.lit("["), text, F.lit(tail)), "array<string>", strict))

    return F.coalesce((items("]") == 1) & (items(",0]") == 2), F.lit(False))
