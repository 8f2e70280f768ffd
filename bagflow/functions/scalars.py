"""Column functions that the jobs use: bearings, times, message fields, text parts, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bearing(lat: Column, lon: Column, prev_lat: Column, prev_lon: Column) -> Column:
    """Initial bearing in degrees, 0 to 360, from the previous to the current position (both in radians)."""
    turn = lon - prev_lon
    y = F.sin(turn) * F.cos(lat)
    x = F.cos(prev_lat) * F.sin(lat) - F.sin(prev_lat) * F.cos(lat) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def direction(lat: Column, lon: Column, prev_lat: Column, prev_lon: Column, *, fix_east: bool = False) -> Column:
    """The bearing's quarter as a label. By default no bearing is east (it asks for 315 or more and 45 or less at once)."""
    deg = bearing(lat, lon, prev_lat, prev_lon)
    label = F.when(deg.between(45.0, 135.0), "north").when(deg.between(135.0, 225.0), "west")
    if fix_east:
        label = F.when((deg >= 315.0) | (deg <= 45.0), "east").when(deg.between(45.0, 135.0), "north").when(deg.between(135.0, 225.0), "west")
    return label.otherwise("south")


def iso_time(text: Column) -> Column:
    """A timestamp from ISO-8601 text; null where it isn't one."""
    return F.try_to_timestamp(text)


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    n = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + n * 1_000_000)


def field(message: Column | str, name: str) -> Column:
    return (F.col(message) if isinstance(message, str) else message).getField(name)


def without(message: Column | str, *names: str) -> Column:
    return (F.col(message) if isinstance(message, str) else message).dropFields(*names)


def with_value(message: Column | str, name: str, value: Column) -> Column:
    return (F.col(message) if isinstance(message, str) else message).withField(name, value)


def first_of(pair: Column) -> Column:
    return F.element_at(pair, 1)


def second_of(pair: Column) -> Column:
    return F.element_at(pair, 2)


def is_even(value: Column) -> Column:
    return F.pmod(value, F.lit(2)) == 0


def parts(text: Column) -> Column:
    """The parts of a text between spaces and line ends, empty ones included (drop those after exploding: a filter of rows
    is compiled, one of an array's elements is interpreted)."""
    return F.split(text, r"[ \n]+")


def words(text: Column) -> Column:
    """The non-empty parts of a text between spaces and line ends."""
    return F.filter(parts(text), lambda w: w != "")


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#(\w+)"), F.lit(1))


def rendered(*columns: Column | str) -> Column:
    """The JSON text of a value, or of an array of several."""
    return F.to_json(F.array(*columns)) if len(columns) > 1 else F.to_json(F.struct(*columns))
