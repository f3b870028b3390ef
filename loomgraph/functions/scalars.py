"""Scalar functions of the graph model as Column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import statements as T

PARAM = ":param"


def url_path(url: Column) -> Column:
    """Path of an http address, without query and fragment; "/" where there is none."""
    p = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def normalise_path(path: Column) -> Column:
    """":id", "{id}" and "<id>" become :param; doubled and trailing slashes go."""
    one = F.regexp_replace(path, r"(?<=/)(:[A-Za-z_]\w*|\{[^/}]+\}|<[^/>]+>)(?=/|$)", PARAM)
    one = F.regexp_replace(one, "/{2,}", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def is_value(segment: Column) -> Column:
    """Segments that look like a value, not a name: empty, with a digit, longer than 32, or with an "@" inside."""
    return (segment == "") | segment.rlike("[0-9]") | (F.length(segment) > 32) | segment.rlike(".@.")


def mask_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(path), lambda x: F.when(is_value(x), ":value").otherwise(x)), "/"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_id(a: Column, kind: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" -"), kind, F.lit("-> "), b)


def join_of_id(x: Column) -> Column:
    p = r"^(.*) -([a-z_]+)-> (.*)$"
    return F.struct(F.regexp_extract(x, p, 1).alias("from_id"), F.regexp_extract(x, p, 2).alias("type"), F.regexp_extract(x, p, 3).alias("to_id"))


def duration_ms(text: Column) -> Column:
    """"90s", "15m", "2h", "7d" in milliseconds; else null."""
    n, unit = F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 1).try_cast("long"), F.regexp_extract(text, r"^(\d+)(ms|s|m|h|d)$", 2)
    return n * F.when(unit == "ms", 1).when(unit == "s", 1000).when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)


def words(name: Column) -> Column:
    """Words of a name in small letters: at capitals, digits' ends and signs."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.split(F.lower(F.trim(spaced)), " "))


def sql_verb(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?i)^\s*(select|insert|update|delete|merge|truncate|with)\b", 1))


def sql_operation(text: Column) -> Column:
    """read, write or delete by what a statement does (the definitions of a WITH are passed over); else null."""
    return T.of_tokens(text, T.statement_operation)


def sql_tables(text: Column) -> Column:
    """Tables that a statement names, in small letters without quotes and schema, less the names that a WITH defines; sorted."""
    return T.of_tokens(text, T.statement_tables)


def sql_is_batch(text: Column) -> Column:
    """Whether a statement takes many rows at once: a list, an array, or an insert of several rows."""
    return T.of_tokens(text, T.statement_is_batch)


def sql_is_conditional(text: Column) -> Column:
    """Whether an update changes a row only in the state it expects, or hands it back."""
    return T.of_tokens(text, T.statement_is_conditional)


def catalog_name(name: Column) -> Column:
    """Small letters, digits and dashes, at most 63 of them."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(63))


def fingerprint(*columns: Column) -> Column:
    """sha-256 of the values by position; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def resource_name(arn: Column) -> Column:
    """The last part of a resource name with colons or slashes."""
    return F.regexp_extract(arn, r"([^:/]+)$", 1)


def span_template(path: Column) -> Column:
    """Value-like segments of a span's path as :param."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(path), lambda x: F.when(is_value(x), PARAM).otherwise(x)), "/"))


def was_read(text: Column) -> Column:
    """Whether no unread hole ("${...}") is left in it."""
    return ~text.contains("${")


def referenced_types(ref: Column) -> Column:
    """Ids of types in a reference such as "Promise<type:a.B[]>"; distinct, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(ref, F.lit(r"(type:[\w.]+)"), 1)))


# Words of names that are open on purpose, and that switch a check off.
PUBLIC_WORDS = "public|anonymous|allow[-_]?anon|guest|unauthenticated|no[-_]?auth|skip[-_]?auth|without[-_]?auth|open[-_]?access"
OPT_OUT_WORDS = "skip|bypass|ignore|exclude|exempt|disable|optional|allow|without|public|anonymous|guest|unauth|no[-_]?auth|open[-_]?access"


def sounds_public(name: Column) -> Column:
    return name.rlike(f"(?i)({PUBLIC_WORDS})")


def sounds_like_opt_out(name: Column) -> Column:
    return name.rlike(f"(?i)({OPT_OUT_WORDS})")


def sounds_like_auth_check(name: Column) -> Column:
    """Whether a word of the name (cut at capitals and signs) begins with the stem of a check."""
    return T.checks_who_asks(name)


def collapse_labels(labels: Column, most: int) -> Column:
    """The first labels in order, and how many more there are."""
    rest = F.size(labels) - most
    return F.concat(F.array_join(F.slice(labels, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))


def repository_key(name: Column) -> Column:
    """Names that differ in case, signs and a common ending are one."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "")), "(service|svc|api)$", "")


def owner_of(symbol: Column) -> Column:
    """What stands before a symbol's last dot: the class of a method; "" where there is none."""
    return F.regexp_extract(symbol, r"^(.+)\.[^.]*$", 1)
