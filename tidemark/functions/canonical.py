"""Forms in which equal values are equal bytes: canonical JSON, its hashes, and times in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """The fields as JSON: names in order, nulls told, no spaces, characters as they are."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def sorted_pairs(pairs: Column, *names: str) -> Column:
    """An array of structs, such as the entries of a map, as sorted arrays of its two named fields."""
    return F.transform(F.array_sort(pairs), lambda p: F.array(p[names[0]], p[names[1]]))


def json_of_map(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def map_of_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def utc_text(moment: Column) -> Column:
    """A timestamp in UTC with microseconds and Z, whatever the session's zone."""
    zone = F.current_timezone()
    return F.date_format(F.to_utc_timestamp(moment, zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day_end(day: Column, zone: str = "Asia/Shanghai") -> Column:
    """The last second of a day in a zone, as a timestamp."""
    return F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(23), F.lit(59), F.lit(59), F.lit(zone))
