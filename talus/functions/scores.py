"""Score expressions of the ranking steps, ages and times to live."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUALITY_SHARE, QUALITY_TOP, HALF_LIFE_DAYS = 0.5, 10_000, 730
DECAY = 0.01
#: Longest time to live, in days.
LONGEST_TTL = 36_500


def quality(citations: Column, age_days: Column, share: float = QUALITY_SHARE, half_life: float = HALF_LIFE_DAYS, top: int = QUALITY_TOP) -> Column:
    """Citations on a log scale and recency by half-life, in equal parts; 0 without citations."""
    cited = F.log(citations + 1) / F.log(F.lit(top + 1.0))
    recent = F.pow(F.lit(0.5), age_days / half_life)
    return F.when(citations > 0, share * cited + (1 - share) * recent).otherwise(F.lit(0.0))


def age_of_year(year: Column, today: dt.date) -> Column:
    """Days since the 15th of June of a year, not below 0."""
    return F.greatest(F.lit(0), F.datediff(F.lit(today), F.make_date(year, F.lit(6), F.lit(15))))


def size_penalty(chunks: Column, most: int = 30) -> Column:
    return F.least(F.lit(1.0), most / F.greatest(F.lit(1), chunks))


def decayed(days: Column, rate: float = DECAY) -> Column:
    """exp(-rate * days); days below 0 count as 0."""
    return F.exp(-rate * F.greatest(F.lit(0.0), days))


def warm_ttl(ttl_days: Column, uses: Column) -> Column:
    """A time to live that grows with use: ttl * (1 + ln(uses + 1))."""
    return ttl_days * (1 + F.log(uses + 1))


def ttl_days(text: str) -> int | None:
    """Days of `30d` or `4w`; None for permanent or never."""
    if text.strip().lower() in ("permanent", "never"):
        return None
    m = re.fullmatch(r"(\d+)([dw])", text.strip().lower())
    days = int(m[1]) * (7 if m[2] == "w" else 1) if m else 0
    if not 0 < days <= LONGEST_TTL:
        raise ValueError(f"not a time to live: {text!r}")
    return days


def ttl_column(text: Column) -> Column:
    """As `ttl_days`, for a column; null for permanent, never, and what can't be read."""
    n = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)[dw]$", 1).try_cast("int")
    days = n * F.when(F.endswith(F.lower(F.trim(text)), F.lit("w")), 7).otherwise(1)
    return F.when(days.between(1, LONGEST_TTL), days)
