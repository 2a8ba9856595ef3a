"""Time windows named in a question, as UTC bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, time, timedelta, timezone

#: Hours of the parts of a day, and seconds of units.
DAY_PARTS = {"morning": (6, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 24)}
UNITS = {"day": 86400, "hour": 3600, "hr": 3600, "minute": 60, "min": 60, "second": 1, "sec": 1}

LAST = re.compile(rf"\blast\s+(\d+)\s+({'|'.join(UNITS)})s?\b", re.I)
SPAN = re.compile(r"(?:\b(?:between|from)\s+|\b)(\d{1,2})(?::(\d\d))?\s*([ap]\.?m\.?)?\s*(?:and|to|until|till|-|–)\s*(\d{1,2})(?::(\d\d))?\s*([ap]\.?m\.?)?(?!\d)", re.I)
AT = re.compile(r"\b(?:at|around|about)\s+(\d{1,2})(?::(\d\d))?\s*([ap]\.?m\.?)?", re.I)


@dataclass(frozen=True)
class Span:
    start: datetime
    end: datetime
    kind: str


def clock(hour: str, minute: str | None, half: str | None) -> time | None:
    """A reading of twelve or twenty-four hours; None if there is no such time."""
    h, m = int(hour), int(minute or 0)
    if m > 59 or (half and not 1 <= h <= 12) or h > 23:
        return None
    if half:
        h = h % 12 + (12 if half.lower().startswith("p") else 0)
    return time(h, m)


def time_span(question: str, now: datetime, offset_minutes: int = 0) -> Span | None:
    """The window that a question names, or None if it names none; wall-clock words are local to the offset."""
    zone = timezone(timedelta(minutes=max(-840, min(840, offset_minutes))))
    local = now.astimezone(zone)
    words = question.lower()
    back = timedelta(days=1 if "yesterday" in words else 0)
    day = datetime.combine(local.date(), time(), zone) - back

    def span(start: datetime, end: datetime, kind: str) -> Span:
        return Span(start.astimezone(timezone.utc), end.astimezone(timezone.utc), kind)

    if m := LAST.search(words):
        return span(now - timedelta(seconds=int(m[1]) * UNITS[m[2]]), now, "relative")
    if m := SPAN.search(words):
        # One half of the day named at either end holds for both.
        a, b = clock(m[1], m[2], m[3] or m[6]), clock(m[4], m[5], m[6] or m[3])
        if a and b:
            start, end = (datetime.combine(day.date(), t, zone) for t in (a, b))
            return span(start, end if end > start else end + timedelta(days=1), "absolute")
    if (m := AT.search(words)) and (t := clock(m[1], m[2], m[3])):
        start = datetime.combine(day.date(), t, zone)
        return span(start, start + timedelta(hours=1), "absolute")
    for name, (first, last) in DAY_PARTS.items():
        if name in words:
            base = day - timedelta(days=1) if name == "night" and "last night" in words and not back else day
            return span(base + timedelta(hours=first), base + timedelta(hours=last), "day_part")
    if back:
        return span(day, day + timedelta(days=1), "day")
    return span(day, now, "day") if "today" in words else None
