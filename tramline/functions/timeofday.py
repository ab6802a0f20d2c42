"""Clock times as HH:MM strings and minutes of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")), F.lit("9999")).cast("int")


def clock(hours: Column, minutes: Column) -> Column:
    return F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))


def _twelve(hours: Column, half: Column) -> Column:
    return hours % 12 + F.when(F.upper(half) == "P", 12).otherwise(0)


HALF, PLAIN = r"(?i)^(\d{1,2}):(\d{2}) *([AP])M$", r"^(\d{1,2}):(\d{2})(?::\d{2})?$"


def normalise(c: Column) -> Column:
    """`h:mm AM/PM`, `h:mm:ss` or `h:mm` as HH:MM; null for anything else."""
    v = F.trim(c)
    half = clock(_twelve(_part(v, HALF, 1), F.regexp_extract(v, HALF, 3)), _part(v, HALF, 2))
    plain = clock(_part(v, PLAIN, 1), _part(v, PLAIN, 2))
    return F.when(v.rlike(HALF) & (_part(v, HALF, 2) < 60), half).when(v.rlike(PLAIN) & (_part(v, PLAIN, 1) < 24) & (_part(v, PLAIN, 2) < 60), plain)


def twelve_hour(c: Column) -> Column:
    """Only `h:mm AM/PM`."""
    v = F.trim(c)
    return F.when(v.rlike(HALF), normalise(v))


def service_day(c: Column) -> Column:
    """`h:mm[:ss]` or `hhmm` with hours up to 27, as runs past midnight are written."""
    v = F.trim(c)
    bare = r"^(\d{2})(\d{2})$"
    ok = lambda p: v.rlike(p) & (_part(v, p, 1) <= 27) & (_part(v, p, 2) < 60)
    return F.when(ok(PLAIN), clock(_part(v, PLAIN, 1), _part(v, PLAIN, 2))).when(ok(bare), clock(_part(v, bare, 1), _part(v, bare, 2)))


# What may follow an hour on a notice board, and the hours that it adds to an hour of the half day.
HALVES = {"am": 0, "midnight": 0, "pm": 12, "noon": 12}


def notice_board(c: Column) -> Column:
    """`h[:mm] [AM|PM|noon|midnight]`; other texts stay as they are but for their spaces, empty ones become null."""
    v = F.trim(F.regexp_replace(c, " +", " "))
    p = rf"(?i)^(\d{{1,2}})(?::(\d{{2}}))? *({'|'.join(HALVES)})?$"
    h, added = _part(v, p, 1), F.create_map(*[F.lit(x) for pair in HALVES.items() for x in pair])
    half = F.try_element_at(added, F.lower(F.regexp_extract(v, p, 3)))
    hour = F.when(half.isNotNull() & (h <= 12), h % 12 + half).otherwise(h)
    return F.when(v.rlike(p), clock(hour, F.coalesce(_part(v, p, 2), F.lit(0)))).otherwise(F.nullif(v, F.lit("")))


def usable(c: Column) -> Column:
    v = F.trim(c)
    return F.when(v.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"), v)


def lenient(c: Column) -> Column:
    """The first `h:mm` anywhere, with an optional half of the day; ranges aren't checked."""
    p = r"(?i)(\d{1,2}):(\d{2}) *(AM|PM)?"
    h, half = _part(c, p, 1), F.upper(F.regexp_extract(c, p, 3))
    hour = F.when((half == "PM") & (h < 12), h + 12).when((half == "AM") & (h == 12), 0).otherwise(h)
    return F.when(c.rlike(p), clock(hour, _part(c, p, 2)))


def minutes(c: Column) -> Column:
    """Minutes of HH:MM, null where it isn't a time."""
    p = r"^(\d{1,2}):(\d{2})$"
    return F.when(c.rlike(p), _part(c, p, 1) * 60 + _part(c, p, 2))


def from_minutes(m: Column) -> Column:
    """HH:MM of minutes, rounded to whole ones first and wrapped at midnight."""
    whole = F.pmod(F.floor(m + 0.5), F.lit(1440)).cast("int")
    return clock(F.floor(whole / 60).cast("int"), whole % 60)


def headway(first: Column, last: Column, every: Column) -> Column:
    """All departures from first to last, in minutes."""
    return F.sequence(first, last, every)
