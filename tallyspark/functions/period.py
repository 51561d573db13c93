"""Months, windows of months and their labels."""

import calendar
import re
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import functions as F

MODES = ("current", "3", "6", "12", "ytd", "all_time")


def first_day(d):
    return F.trunc(d, "MM")


def month_key(d):
    return F.date_format(d, "yyyy-MM")


def month_label(d):
    return F.date_format(d, "MMMM yyyy")


def in_month(d, period: date):
    start, end = month_bounds(period)
    return d.between(F.lit(start), F.lit(end))


def month_bounds(period: date) -> tuple[date, date]:
    return period.replace(day=1), period.replace(day=calendar.monthrange(period.year, period.month)[1])


def add_months(period: date, n: int) -> date:
    k = period.year * 12 + period.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def parse_period(text: str) -> date:
    """The first day of a YYYY-MM month."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", text):
        raise ValueError(f"period must be YYYY-MM, not {text!r}")
    return date(int(text[:4]), int(text[5:]), 1)


def parse_mode(text: str, zero: str = "all_time") -> str:
    """A range mode in any case, blank for the current month; 0 stands for all_time, or for ytd where a caller asks for that."""
    name = text.strip().lower() or "current"
    mode = zero if name == "0" else name.removeprefix("rolling_")
    if mode not in MODES:
        raise ValueError(f"range must be one of {MODES}, not {text!r}")
    return mode


def parse_card(text: str) -> str:
    """all (or blank), or a card's id in its usual form."""
    return "all" if text in ("", "all") else str(uuid.UUID(text))


def parse_selection(period: str, card: str, mode: str, zero: str = "ytd") -> "Selection":
    return Selection(parse_period(period), parse_card(card), parse_mode(mode, zero))


def validate(limit: int = 50, page: int = 1, offset: int = 0, range_: int = 6, merchants: int = 10) -> None:
    if range_ not in (0, 3, 6, 12) or not 1 <= limit <= 200 or not 1 <= page <= 200 or not 0 <= offset <= 10_000 or not 1 <= merchants <= 50:
        raise ValueError("range is 0, 3, 6 or 12, limit and page 1 to 200, offset 0 to 10000, merchants 1 to 50")


@dataclass(frozen=True)
class Selection:
    period: date
    card: str | int = "all"
    mode: str = "current"

    def window(self, earliest: date | None = None) -> tuple[date, date]:
        """First and last day, anchored to the period; all_time starts in the earliest month."""
        start, end = month_bounds(self.period)
        if self.mode in ("3", "6", "12"):
            return add_months(start, 1 - int(self.mode)), end
        if self.mode == "ytd":
            return date(start.year, 1, 1), end
        if self.mode == "all_time":
            return (min(earliest, start) if earliest else start).replace(day=1), end
        return start, end

    def label(self) -> str:
        if self.mode in ("3", "6", "12"):
            return f"Last {self.mode} months"
        return {"ytd": "Year to date", "all_time": "All time"}.get(self.mode, f"{calendar.month_name[self.period.month]} {self.period.year}")
