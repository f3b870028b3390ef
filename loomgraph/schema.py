"""Domains of the graph model, as ordered tuples (weakest or mildest first), and the schemas of its tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("heuristic", "declared", "marker", "static", "runtime")
SEVERITY = ("info", "warning", "error")
NODES = "id string, type string, kind string, label string, service string, repo string, file string, line int, meta string"
EDGES = "from_id string, to_id string, type string, confidence string, params array<string>, returns string, file string, line int, meta string"
TYPES = "id string, name string, kind string, repo string, declared_in string, structural_hash string, fields array<struct<name:string,type:string,optional:boolean>>, members array<string>"
UNRESOLVED = "id long, service string, file string, line int, reason string, level string, sites int, message string, hint string, kind string, risk string"
SPANS = (
    "trace_id string, span_id string, parent_id string, service string, kind string, method string, route string, path string, "
    "destination string, at timestamp, status int, duration_ms double, error boolean"
)


def rank(value: Column, domain: tuple[str, ...] = CONFIDENCE) -> Column:
    """Place of a value in its domain, from 0; null for values outside it."""
    out = F.lit(None).cast("int")
    for i, x in enumerate(domain):
        out = F.when(value == x, i).otherwise(out)
    return out


def named(place: Column, domain: tuple[str, ...] = CONFIDENCE) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in domain]), place + 1)
