"""The function catalogue: Spark's own functions, and the few that Spark lacks or spells otherwise.

Every name resolves to a native Catalyst expression; nothing here runs Python on the executors. Unless a docstring says
otherwise, a function that this module does not define is Spark's, unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as _f
from pyspark.sql.functions import *  # noqa: F403

ColumnOrName = Column | str


def _col(c: Any) -> Column:
    return c if isinstance(c, Column) else _f.col(c)


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else _f.lit(v)


# --- conditions ------------------------------------------------------------------------------------------------------


def isin(column: ColumnOrName, *values: Any) -> Column:
    """Whether a column's value is among the values (or in the one list given)."""
    only = values[0] if len(values) == 1 and isinstance(values[0], list | tuple | set) else values
    return _col(column).isin(*only)


def case_when(*conditions: tuple[Column, Any], else_value: Any = None) -> Column:
    """CASE over (condition, value) pairs; null, or else_value, where none holds."""
    if not conditions:
        return _value(else_value)
    out = _f.when(conditions[0][0], _value(conditions[0][1]))
    for condition, value in conditions[1:]:
        out = out.when(condition, _value(value))
    return out if else_value is None else out.otherwise(_value(else_value))


def cast(column: ColumnOrName, data_type: Any) -> Column:
    """A cast that gives null, not an error, for values that do not fit."""
    return _col(column).try_cast(data_type)


# --- strings ---------------------------------------------------------------------------------------------------------


def to_str(column: ColumnOrName) -> Column:
    return _col(column).cast("string")


def to_varchar(column: ColumnOrName, length: int | Column | str | None = None) -> Column:
    """Text of at most length characters; a format string works as in Spark."""
    if isinstance(length, str | Column):
        return _f.to_varchar(_col(column), _value(length))
    text = _col(column).cast("string")
    return text if length is None else _f.substring(text, 1, length)


def regexp_substr(column: ColumnOrName, pattern: str | Column, pos: int = 1, occurrence: int = 1) -> Column:
    """The given match at or after position pos (from 1), null if there are fewer."""
    found = _f.regexp_extract_all(_f.substring(_col(column), pos, 2**31 - 1), _value(pattern), _f.lit(0))
    return _f.get(found, occurrence - 1)


def regexp_instr(column: ColumnOrName, pattern: str, pos: int = 1, occurrence: int = 1) -> Column:
    """Position (from 1) of the given match at or after pos; 0 if there are fewer."""
    text = _f.substring(_col(column), pos, 2**31 - 1)
    # What precedes the match: the shortest run that holds occurrence - 1 matches and ends before one more.
    before = _f.regexp_extract(text, f"(?s)^((?:.*?(?:{pattern})){{{occurrence - 1}}}.*?)(?:{pattern})", 1)
    enough = _f.size(_f.regexp_extract_all(text, _f.lit(pattern), _f.lit(0))) >= occurrence
    return _f.when(_col(column).isNull(), _f.lit(None)).when(enough, _f.length(before) + pos).otherwise(0).cast("int")


def elt(n: ColumnOrName | int, *columns: ColumnOrName) -> Column:
    """The n-th of the columns (from 1), null if there is none."""
    return _f.try_element_at(_f.array(*[_col(c) for c in columns]), _value(n) if not isinstance(n, str) else _col(n))


def json_array_length(column: ColumnOrName, path: str | None = None) -> Column:
    """Length of a JSON array, or of the one at a path."""
    return _f.json_array_length(_col(column) if path is None else _f.get_json_object(_col(column), path))


def json_object_keys(column: ColumnOrName, path: str | None = None) -> Column:
    """Keys of a JSON object, or of the one at a path."""
    return _f.json_object_keys(_col(column) if path is None else _f.get_json_object(_col(column), path))


# --- dates and intervals ---------------------------------------------------------------------------------------------


def timestampadd(unit: str, quantity: int | ColumnOrName, timestamp: ColumnOrName) -> Column:
    """A timestamp so many units later."""
    n = _f.lit(quantity) if isinstance(quantity, int) else _col(quantity)
    return _timestamp_add(unit, n, _col(timestamp))


def _timestamp_add(unit: str, n: Column, ts: Column) -> Column:
    unit = unit.upper()
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return ts + _f.make_ym_interval(_f.lit(0), (n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]).cast("int"))
    micros = {
        "WEEK": 604_800_000_000, "DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000,
        "MILLISECOND": 1_000, "MICROSECOND": 1,
    }[unit]
    seconds = (n.cast("decimal(20,0)") * _f.lit(micros)).cast("decimal(28,0)") / _f.lit(1_000_000)
    return ts + _f.make_dt_interval(_f.lit(0), _f.lit(0), _f.lit(0), seconds.cast("decimal(18,6)"))


def timestampdiff(unit: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole units from start to end."""
    unit = unit.upper()
    a, b = _col(start).cast("timestamp"), _col(end).cast("timestamp")
    if unit in ("YEAR", "QUARTER", "MONTH"):
        months = _f.months_between(b, a, False)
        return (_f.signum(months) * _f.floor(_f.abs(months) / {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit])).cast("long")
    micros = {
        "WEEK": 604_800_000_000, "DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000,
        "MILLISECOND": 1_000, "MICROSECOND": 1,
    }[unit]
    gap = _f.unix_micros(b) - _f.unix_micros(a)
    return (_f.signum(gap) * _f.floor(_f.abs(gap) / micros)).cast("long")


def dateadd(date_part: str | ColumnOrName, value: Any, date: ColumnOrName | None = None) -> Column:
    """dateadd(part, n, date), or dateadd(date, days) as in Spark."""
    if date is None:
        return _f.dateadd(_col(date_part), _value(value))
    return timestampadd(str(date_part), value, date)


def datepart(date_part: str, date: ColumnOrName) -> Column:
    return _f.date_part(_f.lit(date_part), _col(date))


def days(n: ColumnOrName) -> Column:
    """An interval of so many days."""
    return _f.make_interval(days=_col(n).cast("int"))


def hours(n: ColumnOrName) -> Column:
    """An interval of so many hours."""
    return _f.make_interval(hours=_col(n).cast("int"))


def months(n: ColumnOrName) -> Column:
    """An interval of so many months."""
    return _f.make_interval(months=_col(n).cast("int"))


def years(n: ColumnOrName) -> Column:
    """An interval of so many years."""
    return _f.make_interval(years=_col(n).cast("int"))


# --- names in other spellings ----------------------------------------------------------------------------------------


def approxCountDistinct(column: ColumnOrName, rsd: float | None = None) -> Column:  # noqa: N802
    return _f.approx_count_distinct(column, rsd)


def sumDistinct(column: ColumnOrName) -> Column:  # noqa: N802
    return _f.sum_distinct(_col(column))


def countDistinct(column: ColumnOrName, *columns: ColumnOrName) -> Column:  # noqa: N802
    return _f.count_distinct(column, *columns)


def bitwiseNOT(column: ColumnOrName) -> Column:  # noqa: N802
    return _f.bitwise_not(column)


def shiftLeft(column: ColumnOrName, num_bits: int) -> Column:  # noqa: N802
    return _f.shiftleft(column, num_bits)


def shiftRight(column: ColumnOrName, num_bits: int) -> Column:  # noqa: N802
    return _f.shiftright(column, num_bits)


def shiftRightUnsigned(column: ColumnOrName, num_bits: int) -> Column:  # noqa: N802
    return _f.shiftrightunsigned(column, num_bits)


def toDegrees(column: ColumnOrName) -> Column:  # noqa: N802
    return _f.degrees(column)


def toRadians(column: ColumnOrName) -> Column:  # noqa: N802
    return _f.radians(column)


# --- exact forms of approximate aggregates ---------------------------------------------------------------------------


def exact_count_distinct(column: ColumnOrName) -> Column:
    """approx_count_distinct, exactly: it costs a second exchange by the column."""
    return _f.count_distinct(_col(column))


def exact_percentile(column: ColumnOrName, percentage: float | list[float]) -> Column:
    """approx_percentile with linear interpolation, exactly."""
    return _f.percentile(_col(column), percentage)


def call_function(name: str, *columns: ColumnOrName) -> Column:
    """A function of this module by name, else one that Spark has registered."""
    found = globals().get(name)
    if callable(found) and not name.startswith("_"):
        return found(*columns)
    return _f.call_function(name, *[_col(c) for c in columns])


def lookup(name: str) -> Callable[..., Column]:
    """The function of a name in this catalogue."""
    found = globals().get(name)
    if not callable(found) or name.startswith("_"):
        raise AttributeError(f"no such function: {name}")
    return found
