"""Instants given as text, validity intervals, and rounding, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that a current view leaves out (fixed values).
EXCLUDED_CURRENT = ["superseded", "invalidated", "archived", "rejected", "preparing", "repair_required", "rolled_back"]
#: Of those, the ones that a view as of an instant may still show (fixed values).
SHOWN_AS_OF = ["superseded", "invalidated", "archived"]
_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def strict_instant(c: Column) -> Column:
    """The instant of an ISO text with a zone; null for any other text, one without a zone included."""
    return F.when(c.rlike(_ZONED), F.try_to_timestamp(c))


def validity_reason(status: Column, valid_from: Column, valid_to: Column, mode: str, instant: Column) -> Column:
    """Why a row is in or out of a view. Only currently_valid, valid_at_requested_time and history_requested are in.

    A malformed bound excludes the row in every mode, history too; the end of an interval is exclusive.
    """
    status = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    start, end = strict_instant(valid_from), strict_instant(valid_to)
    given = lambda c: c.isNotNull() & (c != "")
    out = F.when((status == "") & F.lit(mode != "history"), "missing_status").when(given(valid_from) & start.isNull(), "malformed_valid_from").when(given(valid_to) & end.isNull(), "malformed_valid_to")
    if mode == "history":
        return out.otherwise("history_requested")
    hidden = status.isin(EXCLUDED_CURRENT) & (~status.isin(SHOWN_AS_OF) if mode == "as_of" else F.lit(True))
    return out.when(hidden, F.concat(F.lit("status_"), status)).when(start > instant, "not_yet_valid").when(end <= instant, "expired").otherwise("valid_at_requested_time" if mode == "as_of" else "currently_valid")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, clamped to 0..100 and rounded half to even; null where there is no whole."""
    return F.when(whole > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(part * 100.0 / whole))).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def backoff_seconds(attempt: Column) -> Column:
    """60 s, doubled for each attempt after the first, an hour at most."""
    return F.least(F.lit(3600.0), 60.0 * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")
