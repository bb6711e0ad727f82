"""Keys of web-log requests, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_key(host: Column) -> Column:
    """host without outer blanks and tabs, then without one final dot, in lower case; null if null, empty or `-`."""
    bare = F.btrim(host, F.lit(" \t"))
    key = F.lower(F.when(bare.endswith("."), F.left(bare, F.length(bare) - 1)).otherwise(bare))
    return F.when((key != "") & (key != "-"), key)


def url_key(url: Column) -> Column:
    """url up to the first `?` or `#`; null unless it begins with `/`."""
    key = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    return F.when(key.startswith("/"), key)


def area(key: Column) -> Column:
    """The text of a url_key between its first `/` and the next, or the end."""
    return F.split_part(key, F.lit("/"), F.lit(2))


def request_minute(day: Column, hour: Column, minute: Column) -> Column:
    """Minutes since 1970-01-01, in the log's own time; null where any part is null or out of range."""
    usable = hour.between(0, 23) & minute.between(0, 59)
    return F.when(usable, F.unix_date(day).cast("bigint") * 1440 + hour * 60 + minute)


def minute_text(minute: Column) -> Column:
    """A count of minutes since 1970-01-01 as yyyy-MM-dd HH:mm; no time zone takes part."""
    of_day = F.pmod(minute, F.lit(1440))
    day = F.date_from_unix_date(F.floor((minute - of_day) / 1440).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(of_day / 60)), F.lit(":"), two(F.pmod(of_day, F.lit(60))))
