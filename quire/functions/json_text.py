"""JSON inside of other text: replies in fences, output of tools after their logs, files that may be broken; and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import col, strip


def reply_object(c: Column | str) -> Column:
    """The JSON object of a reply as text: without a code fence, or else from the first brace to the last; null if there is none."""
    s = strip(F.coalesce(col(c), F.lit("")))
    s = F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```\z", ""))).otherwise(s)
    first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring(s, first, last - first + 1))
    return F.coalesce(as_object(s), F.when(F.try_parse_json(s).isNull(), as_object(inner)))


def as_object(s: Column) -> Column:
    v = F.try_parse_json(s)
    return F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), s)


def last_json(c: Column | str) -> Column:
    """The JSON value that a tool's output ends with: all of it, or else from the last line on that begins one and parses up to the end."""
    s = strip(F.coalesce(col(c), F.lit("")))
    lines = F.split(s, r"\r?\n")
    tails = F.transform(F.sequence(F.size(lines), F.lit(1), F.lit(-1)), lambda k: F.when(strip(F.element_at(lines, k)).rlike(r"^[\[{]"), F.array_join(F.slice(lines, k, F.size(lines) - k + 1), "\n")))
    found = F.filter(tails, lambda t: t.isNotNull() & F.try_parse_json(t).isNotNull())
    return F.when(s == "", None).when(F.try_parse_json(s).isNotNull(), s).otherwise(F.try_element_at(found, F.lit(1)))


def tolerant(c: Column | str, default: str) -> Column:
    """A document's JSON text, or a default where it is missing or broken."""
    return F.when(F.try_parse_json(col(c)).isNotNull(), col(c)).otherwise(F.lit(default))


def utc_stamp(c: Column | str) -> Column:
    """An ISO time as UTC to the second, such as 2024-01-02T03:04:05Z; without an offset it is UTC already; null if it is no time."""
    s = strip(col(c))
    zoned = F.when(s.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z"), s).otherwise(F.concat(s, F.lit("Z")))
    seconds = F.unix_micros(F.try_to_timestamp(zoned))
    return F.date_format(F.timestamp_micros(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_stamp(c: Column | str) -> Column:
    """A time as a name for folders, such as 20260920-224712."""
    return F.date_format(col(c), "yyyyMMdd-HHmmss")
