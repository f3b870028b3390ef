"""Contracts between types: structural hashes, wire rules, envelopes, status of pairs, what extra fields cost, JSON Schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import SEVERITIES, compare_fields, flatten_types

#: The rules by which a type changes on its way over a wire, in the order in which they are applied.
WIRE_RULES = ("undefined-vanishes", "optional-accepts-null", "date-string", "bigint-string", "buffer-string", "objectid-string", "set-map-json", "class-transformer", "any-unknown-skip")


def wire_types(fields: DataFrame) -> DataFrame:
    """fields (…, type, optional) as they arrive, with `rules`: which of the nine rules touched each of them.

    undefined in a union makes a field optional; null beside an optional field goes; dates, big integers, buffers and object ids
    are strings, sets arrays, maps objects; a class that a transformer writes ("Class<X>") is its plain X; any and unknown are
    not compared ("*").
    """
    parts = F.array_sort(F.transform(F.split("type", r"\s*\|\s*"), lambda x: F.trim(x)))
    vanishes = F.array_contains(parts, "undefined")
    kept = F.filter(parts, lambda x: x != "undefined")
    loose = F.col("optional") | vanishes
    nulls = loose & F.array_contains(kept, "null") & (F.size(kept) > 1)
    kept = F.when(nulls, F.filter(kept, lambda x: x != "null")).otherwise(kept)
    inner = lambda x, n: F.substring(x, n + 2, 1 << 20)

    def wired(x: Column) -> Column:
        return (
            F.when(x.isin("Date", "bigint", "Buffer", "ObjectId"), "string").when(x.startswith("Set<"), F.concat(F.lit("Array<"), inner(x, 3))).when(x.startswith("Map<"), "object")
            .when(x.startswith("Class<"), F.regexp_extract(x, r"^Class<(.*)>$", 1)).when(x.isin("any", "unknown"), "*").otherwise(x)
        )

    has = lambda f: F.exists(kept, f)
    touched = (vanishes, nulls, has(lambda x: x == "Date"), has(lambda x: x == "bigint"), has(lambda x: x == "Buffer"), has(lambda x: x == "ObjectId"), has(lambda x: x.startswith("Set<") | x.startswith("Map<")), has(lambda x: x.startswith("Class<")), has(lambda x: x.isin("any", "unknown")))
    rules = F.filter(F.array(*[F.when(t, n) for t, n in zip(touched, WIRE_RULES, strict=True)]), lambda x: x.isNotNull())
    whole = F.array_join(F.array_sort(F.array_distinct(F.transform(kept, wired))), " | ")
    return fields.withColumn("rules", rules).withColumn("_t", F.when(F.array_contains(F.transform(kept, wired), "*"), "*").otherwise(whole)).withColumn("optional", loose).withColumn("type", F.col("_t")).drop("_t")


def structural_hashes(types: DataFrame, depth: int = 3) -> DataFrame:
    """(id, structural_hash): 16 hexadecimal digits over the fields to `depth`, whatever their order and the names of the types.

    Fields are sorted, members of a union too; a field of another type counts by its own fields. Types have bounded fields, so
    the list of a type's paths is one row's array.
    """
    flat = flatten_types(types, depth)
    members = F.array_join(F.array_sort(F.transform(F.split("type", r"\s*\|\s*"), lambda x: F.when(x.startswith("type:"), "{}").otherwise(x))), "|")
    line = F.concat("path", F.when(F.col("optional"), "?").otherwise(""), F.lit(":"), members)
    return flat.groupBy("id").agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), ";"), 256), F.lit(16)).alias("structural_hash"))


def drift(types: DataFrame) -> DataFrame:
    """types (name, repo, structural_hash): names that two or more repositories declare in two or more ways."""
    out = types.groupBy("name").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("structural_hash").alias("forms"))
    return out.filter("repos > 1 and forms > 1")


def unwrapped(fields: DataFrame, names: tuple[str, ...] = ("data", "result", "payload", "body")) -> DataFrame:
    """(id, envelope, path, type, optional): a type whose only field besides plain marks is one of `names` is read through it.

    fields are flattened; an envelope has exactly one such field with fields below it. Paths then begin below it.
    """
    top = fields.filter(~F.col("path").contains("."))
    below = fields.filter(F.col("path").contains(".")).select("id", F.substring_index("path", ".", 1).alias("first")).distinct()
    wide = top.join(below, (top["id"] == below["id"]) & (top["path"] == below["first"]), "left").select(top["id"], "path", F.col("first").isNotNull().alias("nested"))
    own = wide.groupBy("id").agg(F.count_if("nested").alias("nested"), F.max(F.when(F.col("nested") & F.col("path").isin(*names), F.col("path"))).alias("envelope"))
    env = own.filter("nested = 1 and envelope is not null").select("id", "envelope")
    met = fields.join(env, "id", "left")
    inside = met.filter(F.col("envelope").isNull() | F.col("path").startswith(F.concat("envelope", F.lit("."))))
    return inside.select("id", "envelope", F.when(F.col("envelope").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(envelope) + 2)")).alias("path"), "type", "optional")


def pair_status(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """pairs (pair, sent, wanted: type ids or null) -> (pair, status shared|identical|hash_differs|unchecked)."""
    h = hashes.select("id", "structural_hash")
    met = pairs.join(h.select(F.col("id").alias("sent"), F.col("structural_hash").alias("a")), "sent", "left").join(h.select(F.col("id").alias("wanted"), F.col("structural_hash").alias("b")), "wanted", "left")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "unchecked").when(F.col("sent") == F.col("wanted"), "shared").when(F.col("a") == F.col("b"), "identical").otherwise("hash_differs")
    return met.select("pair", "sent", "wanted", status.alias("status"))


def check(pairs: DataFrame, types: DataFrame, ignored: list[str] = (), reached: DataFrame | None = None) -> DataFrame:
    """(pair, status, path, kind, severity): findings of pairs that differ, and a row without a finding for every other pair.

    Fields are compared as they arrive over the wire. Findings whose path an entry of `ignored` names, or lies below it, go.
    With reached (pair), findings of pairs that no entry reaches are softened by one step. Two joins by type and one by path.
    """
    status = pair_status(pairs, structural_hashes(types))
    flat = wire_types(flatten_types(types)).filter("type <> '*'")
    differ = status.filter("status = 'hash_differs'")
    own = lambda side: differ.select("pair", F.col(side).alias("id")).join(flat, "id").select("pair", "path", F.when(F.col("type").startswith("type:"), "{}").otherwise(F.col("type")).alias("type"), "optional")
    found = compare_fields(own("sent"), own("wanted"))
    for p in ignored:
        found = found.filter((F.col("path") != p) & ~F.col("path").startswith(p + "."))
    if reached is not None:
        met = found.join(reached.select("pair", F.lit(True).alias("r")).distinct(), "pair", "left")
        soft = F.when(F.col("r"), F.col("severity")).when(F.col("severity") == "error", "warning").otherwise("info")
        found = met.withColumn("severity", soft).drop("r")
    return status.select("pair", "status").join(found, "pair", "left").select("pair", "status", "path", "kind", "severity")


def severities(findings: DataFrame, hardened: dict[str, str] | None = None) -> DataFrame:
    """findings (…, kind, impact) with severity: the kind's own, one step less where nothing reads it, one more where it is stored."""
    steps = ("info", "warning", "error")
    base = F.lit(None).cast("int")
    for k, v in {**SEVERITIES, **(hardened or {})}.items():
        base = F.when(F.col("kind") == k, steps.index(v)).otherwise(base)
    moved = base + F.when(F.col("impact") == "stored", 1).when(F.col("impact") == "unread", -1).otherwise(0)
    return findings.withColumn("severity", F.element_at(F.array(*[F.lit(x) for x in steps]), F.greatest(F.lit(0), F.least(F.lit(2), moved)) + 1))


def strip_impact(extra: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """extra (type, path) fields that a receiver would drop -> impact stored|unread|unknown|none.

    reads (type, path) are paths that the receiver reads, writes (type, path) those that it stores; a path counts for all below
    it. A type of which no read is known at all is unknown; a field that is read elsewhere is none of these.
    """
    ways = extra.select("type", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda n: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), n), "."))).alias("up"))
    mark = lambda df, name: df.select("type", F.col("path").alias("up"), F.lit(True).alias(name)).distinct()
    met = ways.join(mark(reads, "read"), ["type", "up"], "left").join(mark(writes, "stored"), ["type", "up"], "left")
    own = met.groupBy("type", "path").agg(F.max("read").alias("read"), F.max("stored").alias("stored"))
    known = reads.select("type").union(writes.select("type")).distinct().withColumn("known", F.lit(True))
    impact = F.when(F.col("stored"), "stored").when(F.col("known").isNull(), "unknown").when(F.col("read"), "none").otherwise("unread")
    return own.join(known, "type", "left").select("type", "path", impact.alias("impact"))


def finding_key(*parts: Column) -> Column:
    """The parts of a finding with bars between them; bars inside a part are doubled, missing parts are empty."""
    return F.array_join(F.array(*[F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("|"), F.lit("||")) for p in parts]), "|")


def shape_types(shapes: DataFrame) -> DataFrame:
    """shapes (entry, path, types array<string>, optional) -> type entries (id, fields): one for each entry and nested path."""
    s = shapes.withColumn("parent", F.when(F.col("path").contains("."), F.regexp_extract("path", r"^(.*)\.[^.]+$", 1)).otherwise("")).withColumn("name", F.substring_index("path", ".", -1))
    id_ = F.concat(F.lit("type:observed#"), "entry", F.when(F.col("parent") == "", "").otherwise(F.concat(F.lit("."), "parent")))
    nested = F.concat(F.lit("type:observed#"), "entry", F.lit("."), "path")
    kind = F.array_join(F.array_sort(F.transform("types", lambda t: F.when(t == "object", nested).otherwise(t))), " | ")
    field = F.struct("name", kind.alias("type"), F.col("optional").alias("optional"))
    return s.groupBy(id_.alias("id")).agg(F.array_sort(F.collect_list(field)).alias("fields"))


def json_schemas(types: DataFrame) -> DataFrame:
    """(id, schema): JSON Schema of object types, with references for nested ones; fields in order of their names."""
    plain = lambda t: F.when(t.isin("string", "number", "boolean"), F.concat(F.lit('{"type":"'), t, F.lit('"}'))).when(t == "Date", F.lit('{"type":"string","format":"date-time"}')).when(t.startswith("type:"), F.concat(F.lit('{"$ref":"#/components/schemas/'), F.substring(t, 6, 1 << 20), F.lit('"}'))).otherwise(F.lit("{}"))

    def schema(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\s*\|\s*"), lambda x: F.trim(x)), lambda x: x != "undefined")
        return F.when(F.size(parts) == 1, plain(F.get(parts, F.lit(0)))).otherwise(F.concat(F.lit('{"anyOf":['), F.array_join(F.transform(parts, plain), ","), F.lit("]}")))

    order = F.array_sort("fields")
    names = F.transform(order, lambda f: F.concat(F.lit('"'), f["name"], F.lit('":'), schema(f["type"])))
    need = F.transform(F.filter(order, lambda f: ~f["optional"] & ~f["type"].contains("undefined")), lambda f: F.concat(F.lit('"'), f["name"], F.lit('"')))
    doc = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(names, ","), F.lit("}"), F.when(F.size(need) > 0, F.concat(F.lit(',"required":['), F.array_join(need, ","), F.lit("]"))).otherwise(""), F.lit("}"))
    return types.select("id", doc.alias("schema"))


def declaration_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, path, change added|removed|type|optionality) of flattened fields between two versions of types that both have."""
    both = base.select("id").distinct().join(head.select("id").distinct(), "id")
    a = base.join(both, "id", "left_semi").select("id", "path", F.col("type").alias("a"), F.col("optional").alias("x"))
    b = head.join(both, "id", "left_semi").select("id", "path", F.col("type").alias("b"), F.col("optional").alias("y"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "type").when(F.col("x") != F.col("y"), "optionality")
    return a.join(b, ["id", "path"], "full").select("id", "path", change.alias("change")).filter("change is not null")


def dead_fields(findings: DataFrame) -> DataFrame:
    """findings (type, path, kind, dropped) of kind extra_field: fields that nobody takes, those that are dropped first."""
    extra = findings.filter("kind = 'extra_field'")
    return extra.groupBy("type", "path").agg(F.count("*").alias("pairs"), F.bool_or("dropped").alias("dropped"))


# The level of each change of a document that clients read.
SPEC_LEVELS = {"operation added": "info", "operation removed": "error", "property added": "info", "property removed": "warning", "property type": "error", "now required": "error", "now optional": "info"}


def schema_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(op, path, change, level): operations and properties of two documents, each side (op, path, type, required)."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("op", "path", F.col("type").alias(f"{p}t"), F.col("required").alias(f"{p}r"))

    ops = base.select("op").distinct().withColumn("a", F.lit(1)).join(head.select("op").distinct().withColumn("b", F.lit(1)), "op", "full")
    gone = ops.filter("a is null or b is null").select("op", F.lit(None).cast("string").alias("path"), F.when(F.col("a").isNull(), "operation added").otherwise("operation removed").alias("change"))
    both = side(base, "a").join(side(head, "b"), ["op", "path"], "full").join(ops.filter("a is not null and b is not null").select("op"), "op", "left_semi")
    change = F.when(F.col("at").isNull(), "property added").when(F.col("bt").isNull(), "property removed").when(F.col("at") != F.col("bt"), "property type").when(~F.col("ar") & F.col("br"), "now required").when(F.col("ar") & ~F.col("br"), "now optional")
    rows = gone.unionByName(both.select("op", "path", change.alias("change")).filter("change is not null"))
    level = F.lit(None).cast("string")
    for k, v in SPEC_LEVELS.items():
        level = F.when(F.col("change") == k, v).otherwise(level)
    return rows.withColumn("level", level)


def against_document(code: DataFrame, document: DataFrame) -> DataFrame:
    """schema_changes from the document to the code, with `side`: what only the code has is undocumented, what it lacks is stale."""
    found = schema_changes(document, code)
    return found.withColumn("side", F.when(F.col("change").endswith("added"), "undocumented").when(F.col("change").endswith("removed"), "stale").otherwise("differs"))


def failures(changes: DataFrame, fail_on: str = "warning") -> DataFrame:
    """Changes at or over a level."""
    steps = ["info", "warning", "error"]
    return changes.filter(F.col("level").isin(steps[steps.index(fail_on) :]))
