"""Time: flexible 'since' values, buckets from the epoch, gap-free spines."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a unit, by the letter of a duration's date part and time part, and by its name.
_DATE = {"Y": 365 * 86400, "M": 30 * 86400, "W": 7 * 86400, "D": 86400}
_TIME = {"H": 3600, "M": 60, "S": 1}
_SHORT = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31557600}
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}
#: Spellings of the short units, and numbers as words.
_SPELLINGS = {"ms": "ms", **dict.fromkeys("s sec secs second seconds".split(), "s"), **dict.fromkeys("m min mins minute minutes".split(), "m"), **dict.fromkeys("h hr hrs hour hours".split(), "h"), **dict.fromkeys("d day days".split(), "d"), **dict.fromkeys("w week weeks".split(), "w"), **dict.fromkeys("y yr yrs year years".split(), "y")}
_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}


def _designated(part: str, units: dict[str, int]) -> int | None:
    """Seconds of numbers that each bear a unit's letter, in the units' order; None if part is anything else."""
    total, left = 0, list(units)
    while part:
        digits = len(part) - len(part.lstrip("0123456789"))
        letter = part[digits : digits + 1]
        if not digits or letter not in left:
            return None
        total += int(part[:digits]) * units[letter]
        left, part = left[left.index(letter) + 1 :], part[digits + 1 :]
    return total


def _duration(text: str) -> float | None:
    """Seconds of an ISO 8601 duration."""
    date, clock, time = text.removeprefix("+").removeprefix("-").partition("T")
    if not date.startswith("P") or text == "P" or (clock and not time) or len(date) + len(time) < 2:
        return None
    days, seconds = _designated(date[1:], _DATE), _designated(time, _TIME)
    return None if days is None or seconds is None else days + seconds


def _ago(text: str) -> float | None:
    """Seconds of '7d' or '3 days ago' and of 'today', 'yesterday', 'last week'."""
    words = re.sub(r"^(\d+(?:\.\d+)?)(?=[a-z])", r"\1 ", text.lower()).split()
    match words:
        case ["now" | "today"]:
            return 0
        case ["yesterday"]:
            return _UNITS["day"]
        case ["last", ("day" | "week" | "month" | "year") as unit]:
            return _UNITS[unit]
        case [number, unit, "ago"] if unit.removesuffix("s") in _UNITS and (number.isdigit() or number in _WORDS):
            return (int(number) if number.isdigit() else _WORDS[number]) * _UNITS[unit.removesuffix("s")]
        case [number, unit] if unit in _SPELLINGS and re.fullmatch(r"\d+(\.\d+)?", number):
            return float(number) * _SHORT[_SPELLINGS[unit]]
    return None


def _epoch(text: str) -> datetime | None:
    """Seconds since 1970, or milliseconds where there are more than ten digits."""
    if not re.fullmatch(r"\d+(\.\d+)?", text):
        return None
    return datetime.fromtimestamp(float(text) / (1000 if len(text.partition(".")[0]) > 10 else 1), timezone.utc)


def since(value: str | None, now: datetime) -> datetime | None:
    """Epoch seconds or milliseconds, an ISO 8601 duration or date, '7d', '3 days ago', 'yesterday', 'last week'; None for none."""
    if not value:
        return None
    text = value.strip()
    for back in (_ago, _duration):
        if (seconds := back(text)) is not None:
            return now - timedelta(seconds=seconds)
    if (at := _epoch(text)) is not None:
        return at
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"no time in {value!r}: give a date, a span such as 7d or PT12H, or words such as 'two weeks ago'") from None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def bucket(ts: Column, width: str) -> Column:
    """The start of the bucket of a width such as '15 minutes', counted from the epoch."""
    return F.window(ts, width).getField("start")


def spine(spark: SparkSession, start: str, stop: str, step: str, name: str = "at", kind: str = "timestamp_ntz") -> DataFrame:
    """Every step from start to stop, both included."""
    return spark.range(1).select(F.explode(F.expr(f"sequence({kind} '{start}', {kind} '{stop}', interval {step})")).alias(name))


def bucket_minutes(window_minutes: int, buckets: int = 60) -> int:
    """A width that gives about so many buckets, one minute at least."""
    return max(1, -(-window_minutes // buckets))


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, round(value)))


def sane_timestamp(text: Column) -> Column:
    """A timestamp of the years 2020 to 2030, else null."""
    at = F.try_to_timestamp(text)
    return F.when(F.year(at).between(2020, 2030), at)
