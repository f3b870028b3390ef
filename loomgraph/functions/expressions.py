"""Infrastructure-expression functions as Column builders. What cannot be worked out is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(s: Column) -> Column:
    """First letter of each word large, the rest as it is."""
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def trimprefix(s: Column, p: Column) -> Column:
    return F.when(F.startswith(s, p), s.substr(F.length(p) + 1, F.length(s))).otherwise(s)


def trimsuffix(s: Column, p: Column) -> Column:
    return F.when(F.endswith(s, p) & (F.length(p) > 0), F.left(s, F.length(s) - F.length(p))).otherwise(s)


def chomp(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+$", "")


def substr(s: Column, at: int, n: int) -> Column:
    """From 0; a length under 0 is the rest."""
    return s.substr(F.lit(at + 1), F.length(s) if n < 0 else F.lit(n))


def element(a: Column, i: Column) -> Column:
    """Wraps around; null for an empty array."""
    return F.when(F.size(a) > 0, F.try_element_at(a, (F.pmod(i, F.size(a)) + 1).cast("int")))


def lookup(m: Column, k: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, k), default)


def merge(*maps: Column) -> Column:
    """The last map's value of a key wins."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def keys(m: Column) -> Column:
    return F.sort_array(F.map_keys(m))


def values(m: Column) -> Column:
    return F.transform(keys(m), lambda k: F.element_at(m, k))


def compact(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))


def coalesce(*s: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(x != "", x) for x in s])


def coalescelist(*a: Column) -> Column:
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in a])


def zipmap(k: Column, v: Column) -> Column:
    return F.when(F.size(k) == F.size(v), F.map_from_arrays(k, v))


def toset(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def one(a: Column) -> Column:
    """The only element; null for none and for several."""
    return F.when(F.size(a) == 1, F.try_element_at(a, F.lit(1)))


def slice_(a: Column, first: int, end: int) -> Column:
    """From 0, without the element at end."""
    return F.slice(a, first + 1, max(0, end - first))


def range_(first: Column, end: Column) -> Column:
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))


def basename(p: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(p, "/+$", ""), "[^/]*$", 0)


def dirname(p: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(p, "/+$", ""), "/?[^/]*$", "")
    return F.when(d == "", F.when(F.startswith(p, F.lit("/")), "/").otherwise(".")).otherwise(d)


def replace(s: Column, what: str, by: str) -> Column:
    """A pattern between slashes is a regular expression."""
    if len(what) > 1 and what[0] == what[-1] == "/":
        return F.regexp_replace(s, what[1:-1], by)
    return F.replace(s, F.lit(what), F.lit(by))
