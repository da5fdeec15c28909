"""Column expressions shared by every operator (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define the domain (they must equal the line's own vocabulary).
ON_TIME = "ON TIME"
DELAY = "DELAY"
SHIFTS = ("Morning", "Afternoon", "Night")
# Shift boundaries in minutes of the day: Morning [06:00, 14:00), Afternoon [14:00, 22:00), else Night.
MORNING_START, AFTERNOON_START, NIGHT_START = 360, 840, 1320
MINUTES_PER_DAY = 1440
HUMAN_ERROR = "Yes"


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def pct(num, den, digits: int = 2) -> Column:
    """round(num * 100 / nullif(den, 0), digits) computed in DOUBLE (never decimal)."""
    return F.round(c(num).cast("double") * F.lit(100.0) / F.nullif(c(den), F.lit(0)), digits)


def ratio(num, den, digits: int | None = 2) -> Column:
    e = c(num).cast("double") / F.nullif(c(den), F.lit(0))
    return F.round(e, digits) if digits is not None else e


def r(col, digits: int = 2) -> Column:
    return F.round(c(col).cast("double"), digits)


def shift_of(minute_of_day) -> Column:
    """Shift rule on minutes of the day (half-open intervals)."""
    m = c(minute_of_day)
    return (F.when((m >= MORNING_START) & (m < AFTERNOON_START), F.lit("Morning"))
            .when((m >= AFTERNOON_START) & (m < NIGHT_START), F.lit("Afternoon"))
            .otherwise(F.lit("Night")))


def wrap_minutes(start_min, end_min) -> Column:
    """Duration in minutes between two times of day, +1 day when the end is before the start."""
    return F.pmod(c(end_min) - c(start_min), F.lit(MINUTES_PER_DAY))


def minute_of_day(ts) -> Column:
    return F.hour(c(ts)) * 60 + F.minute(c(ts))


def status_of(duration, target) -> Column:
    """Two-level status: on time when the run fits the product's target."""
    return F.when(c(duration) <= c(target), F.lit(ON_TIME)).otherwise(F.lit(DELAY))


def is_on_time(status="status") -> Column:
    return c(status) == F.lit(ON_TIME)


def count_if(cond) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond, value) -> Column:
    return F.sum(F.when(cond, c(value)).otherwise(F.lit(0)))


def is_human(err="operator_error") -> Column:
    return c(err) == F.lit(HUMAN_ERROR)
