"""Times as Column expressions, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, exact; null stays null."""
    zero = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", zero, t)


def from_micros(us: Column) -> Column:
    """The zoneless timestamp of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def iso_to_utc(text: Column) -> Column:
    """Zoneless UTC timestamp of ISO-like text; null where no date and time can be read.

    `T` or blanks between date and time, optional seconds, fraction (cut after microseconds), `Z` or an offset, and
    outer white space are accepted; without an offset the text is UTC already.

    The text is matched once: its parts are written with marks between them and taken apart again; a text with such marks of its own is none.
    """
    pattern = r"(?i)^\s*(\d{4}-\d{1,2}-\d{1,2})(?:T|\s+)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(?:(?<=\.\d{6})\d+)?\s*(?:Z|([+-])(\d{2}):?(\d{2})?)?\s*$"
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("int"), F.lit(0))

    def read(parts: Column) -> Column:
        minutes = (number(parts[2]) * 60 + number(parts[3])) * F.when(parts[1] == "-", -1).otherwise(1)
        return F.when(F.size(parts) == 5, F.timestamp_add("MINUTE", -minutes, parts[0].try_cast("timestamp_ntz")))

    text = F.when(~F.contains(text, F.lit("\u0001")), text)
    parts = F.split(F.regexp_replace(text, pattern, "$1 $2\u0001$3\u0001$4\u0001$5\u0001"), "\u0001")
    return F.transform(F.array(parts), read)[0]
