"""Exact time: ticks of 100 ns as fractions, decimal texts, and their column forms."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone, tzinfo
from fractions import Fraction
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedFormatError

TICKS = 10_000_000
EPOCH = datetime(1601, 1, 1, tzinfo=timezone.utc)
EPOCH_SECONDS = 11_644_473_600  # from 1601 to 1970
DEFAULT_ZONE = "UTC+08:00"
MAX_PLACES = 32


def zone(name: str | tzinfo) -> tzinfo:
    if isinstance(name, tzinfo):
        return name
    if not isinstance(name, str):
        raise TypeError("a time zone is a name or a tzinfo")
    return timezone(timedelta(hours=8)) if name == DEFAULT_ZONE else timezone.utc if name == "UTC" else ZoneInfo(name)


def to_datetime(ticks: Fraction | int, tz: str | tzinfo = DEFAULT_ZONE) -> datetime:
    """Rounded to microseconds, halves to even."""
    return (EPOCH + timedelta(microseconds=round(Fraction(ticks) / 10))).astimezone(zone(tz))


def decimal(value: Fraction | int) -> str:
    """The exact finite decimal of a fraction, without needless zeros."""
    value = Fraction(value)
    for places in range(MAX_PLACES + 1):
        scaled = value * 10**places
        if scaled.denominator == 1:
            digits = str(abs(scaled.numerator)).rjust(places + 1, "0")
            text = digits[: len(digits) - places] + ("." + digits[len(digits) - places :] if places else "")
            return "-" + text if value < 0 else text
    raise UnsupportedFormatError("a time has no exact decimal of 32 places or fewer")


def places(value: Fraction) -> int:
    """Decimal places of a fraction whose decimal is finite."""
    return len(decimal(value).partition(".")[2])


def short_number(value: Fraction, width: int = 8) -> str:
    """An exact text of a positive number in ``width`` characters at most: the shortest of its plain decimal, that without
    its leading zero, and a whole number of powers of ten."""
    plain = decimal(value)
    digits = str(int(value * 10 ** places(value)))
    whole = digits.rstrip("0")
    text = min(plain, plain.removeprefix("0") or plain, f"{whole}E{len(digits) - len(whole) - places(value)}", key=len)
    if len(text) > width:
        raise UnsupportedFormatError(f"a number has no exact text of {width} characters")
    return text


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator of non-negative decimals without a fraction, rounded to an integer, halves to even."""
    whole = (numerator - numerator % denominator) / denominator
    twice = (numerator % denominator) * 2
    return (whole + F.when((twice > denominator) | ((twice == denominator) & (whole % 2 == 1)), 1).otherwise(0)).cast("decimal(38,0)")


def ticks_to_timestamp(numerator: Column, denominator: Column) -> Column:
    """Ticks since 1601 as a timestamp, rounded to microseconds, halves to even."""
    micros = half_even(numerator, denominator * 10).cast("long")
    return F.timestamp_micros(micros - EPOCH_SECONDS * 1_000_000)
