"""The moon and the sun as Column expressions (mean values, good to about a day and a degree)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean length of a lunation in days, and the date of a new moon.
LUNATION, NEW_MOON = 29.530588853, "2000-01-06"


def moon_age(day: Column) -> Column:
    """The share of the lunation that has passed: 0 new, 0.5 full."""
    return F.datediff(day, F.lit(NEW_MOON).cast("date")) % F.lit(LUNATION) / F.lit(LUNATION)


def moon_lit(day: Column) -> Column:
    """The lit share of the disc."""
    return (1 - F.cos(2 * F.pi() * moon_age(day))) / 2


def moon_phase(day: Column) -> Column:
    """The name of the phase."""
    names = ["new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent"]
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(moon_age(day) * 8 + 0.5) % 8 + 1).cast("int"))


def sun_altitude(ts: Column, latitude: float, longitude: float) -> Column:
    """Degrees above the horizon at a UTC time."""
    hours = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
    tilt = F.radians(F.lit(23.44)) * F.sin(2 * F.pi() * (F.dayofyear(ts) - 81) / 365.25)
    angle = F.radians((hours - 12) * 15 + longitude)
    high = F.sin(F.radians(F.lit(latitude))) * F.sin(tilt) + F.cos(F.radians(F.lit(latitude))) * F.cos(tilt) * F.cos(angle)
    return F.degrees(F.asin(high))
