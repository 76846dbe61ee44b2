"""Validity intervals over ISO strings. Five overlap and validity rules with different null and sentinel behaviour."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_TIME, LAST_DAY = "9999-12-31T23:59:59Z", "9999-12-31"


def _from(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _to(x: Column, last: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(last))


def overlap(lf: Column, lt: Column, rf: Column, rt: Column, last: str = LAST_TIME) -> Column:
    """Closed intervals, open where a bound is null or empty."""
    return (_from(lf) <= _to(rt, last)) & (_from(rf) <= _to(lt, last))


def bounds(f: Column, t: Column, last: str = LAST_TIME) -> tuple[Column, Column]:
    """The two bounds that `overlap` compares."""
    return _from(f), _to(t, last)


def overlap_if_given(lf: Column, lt: Column, rf: Column, rt: Column, given: Column) -> Column:
    """False where an interval is missing altogether, or ends before it begins."""
    start = lambda x: F.coalesce(x, F.lit(""))
    end = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(LAST_DAY))
    return given & (F.greatest(start(lf), start(rf)) <= F.least(end(lt), end(rt)))


def overlap_days(lf: Column, lt: Column, rf: Column, rt: Column) -> Column:
    """On days as whole numbers; a malformed date is an error."""
    return (day_rank(lf) <= F.coalesce(day_rank(rt), F.lit(99991231))) & (day_rank(rf) <= F.coalesce(day_rank(lt), F.lit(99991231)))


def valid_at(f: Column, t: Column, day: Column) -> Column:
    """Closed: from <= day <= to, open end where null."""
    return (f <= day) & (t.isNull() | (day <= t))


def valid_half_open(f: Column, t: Column, at: Column) -> Column:
    """from <= at < to, a null bound passes."""
    return (f.isNull() | (f <= at)) & (t.isNull() | (at < t))


def day_rank(d: Column) -> Column:
    """An ISO day as the number YYYYMMDD; null stays null, another shape is an error."""
    return F.when(d.isNull(), F.lit(None).cast("int")).when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(d, F.lit("-"), F.lit("")).cast("int")).otherwise(F.raise_error(F.concat(F.lit("malformed date: "), d)).cast("int"))


def turn_time(start: Column, turn: Column) -> Column:
    """A synthetic timestamp: one minute a turn."""
    return start + F.make_interval(mins=turn)
