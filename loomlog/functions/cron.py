"""Schedules: five fields (minute, hour, day, month, weekday) with ``* ? , - /`` and names, ``@daily`` and its like, ``@every``, and ``TZ=``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARS = 5
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
_UNITS = {"h": 3600, "m": 60, "s": 1}


def _field(text: str, low: int, high: int, names: dict[str, int]) -> tuple[set[int], bool]:
    """The values of a field, and whether it is a star."""
    out: set[int] = set()
    star = False
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        if step and (not step.isdigit() or int(step) == 0):
            raise ValueError(f"bad step in {text!r}")
        if span in ("*", "?"):
            a, b = low, high
            star = star or int(step or 1) == 1
        else:
            a_text, dash, b_text = span.partition("-")
            a = names[a_text] if a_text in names else int(a_text)
            b = (names[b_text] if b_text in names else int(b_text)) if dash else (high if step else a)
        if not low <= a <= b <= high:
            raise ValueError(f"out of range: {text!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out, star


def next_time(schedule: str, after: datetime) -> datetime | None:
    """The first time of a schedule after a UTC time, in UTC; None if there is none in YEARS years. Local times that a change of the clock skips don't happen, those that it repeats happen twice."""
    zone, text = ZoneInfo("UTC"), schedule.strip()
    if m := re.match(r"(?:CRON_)?TZ=(\S+)\s+(.*)", text):
        zone, text = ZoneInfo(m[1]), m[2]
    if text.startswith("@every "):
        given = text[7:].strip()
        seconds = sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)([hms])", given))
        if seconds < 1 or not re.fullmatch(r"(\d+[hms])+", given):
            raise ValueError(f"not a duration: {schedule!r}")
        return after.replace(microsecond=0) + timedelta(seconds=seconds)
    fields = MACROS.get(text, text).split()
    if len(fields) != 5:
        raise ValueError(f"not five fields: {schedule!r}")
    minutes, hours = _field(fields[0], 0, 59, {})[0], _field(fields[1], 0, 23, {})[0]
    (days, any_day), (months, _), (weekdays, any_weekday) = _field(fields[2], 1, 31, {}), _field(fields[3], 1, 12, MONTHS), _field(fields[4], 0, 6, DAYS)
    start = after.replace(tzinfo=UTC).astimezone(zone)
    day = start.date()
    for _ in range(366 * YEARS + 2):
        on_day, on_weekday = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month in months and ((on_day and on_weekday) if any_day or any_weekday else (on_day or on_weekday)):
            times = (t for h in sorted(hours) for m in sorted(minutes) for t in _moments(datetime(day.year, day.month, day.day, h, m, tzinfo=zone)) if t > after)
            changes = datetime(day.year, day.month, day.day, tzinfo=zone).utcoffset() != datetime(day.year, day.month, day.day, 23, 59, tzinfo=zone).utcoffset()
            found = min(times, default=None) if changes else next(times, None)  # where the clock changes, hours needn't be in order
            if found is not None:
                return found
        day += timedelta(days=1)
    return None


def _moments(local: datetime) -> Iterator[datetime]:
    """The UTC times at which a clock shows this local time: none, one or two."""
    seen = set()
    for fold in (0, 1):
        utc = local.replace(fold=fold).astimezone(UTC)
        if utc.astimezone(local.tzinfo).replace(tzinfo=None, fold=0) == local.replace(tzinfo=None, fold=0) and utc not in seen:
            seen.add(utc)
            yield utc.replace(tzinfo=None)


def next_times(schedules: DataFrame, after: datetime) -> DataFrame:
    """schedule and next_at of a table of schedules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"schedule": rows["schedule"], "next_at": pd.to_datetime([next_time(s, after) for s in rows["schedule"]])})

    return schedules.mapInPandas(run, "schedule string, next_at timestamp_ntz")


def request_key(at: Column, job: Column) -> Column:
    """A deterministic version-7 identifier of a job's request: milliseconds of its time, then digits of the job's digest."""
    h = F.lower(F.lpad(F.hex(F.floor(F.unix_micros(at.cast("timestamp")) / 1000)), 12, "0"))
    k = F.md5(job.cast("string").cast("binary"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7"), F.substring(k, 2, 3), F.lit("-8"), F.substring(k, 6, 3), F.lit("-"), F.substring(k, 9, 12))
