"""Trace documents as spans (schema.SPANS): one reader for each format, by explicit schemas and explode; rows stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask_path, url_path

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
OTLP = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,"
    f"name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string>>>>>>>"
)
ZIPKIN = "traceId string, id string, parentId string, name string, kind string, timestamp long, duration long, localEndpoint struct<serviceName:string>, tags map<string,string>"
_TAGS = "array<struct<key:string,type:string,value:string>>"
JAEGER = (
    "data array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,operationName:string,processID:string,startTime:long,duration:long,"
    f"references:array<struct<refType:string,spanID:string>>,tags:{_TAGS}>>,processes:map<string,struct<serviceName:string>>>>"
)
HAR = (
    "log struct<entries:array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>>,"
    "response:struct<status:int>>>>"
)
KINDS = ("internal", "server", "client", "producer", "consumer")


def _attributes(a: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(a, F.array().cast(_ATTRS)), lambda x: F.struct(x["key"], text(x["value"]))))


def _spans(df: DataFrame, **c: Column) -> DataFrame:
    none = F.lit(None)
    kinds = {"at": "timestamp", "status": "int", "duration_ms": "double", "error": "boolean"}
    names = ("trace_id", "span_id", "parent_id", "service", "kind", "method", "route", "path", "destination", "at", "status", "duration_ms", "error")
    return df.select(*_file(df), *[c.get(n, none).cast(kinds.get(n, "string")).alias(n) for n in names])


def _file(df: DataFrame) -> list[str]:
    """The column that says which file a document came from, where there is one."""
    return [c for c in ("file",) if c in df.columns]


def _first(m: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def _path(url: Column) -> Column:
    return mask_path(F.when(url.startswith("/"), F.regexp_extract(url, r"^([^?#]*)", 1)).otherwise(url_path(url)))


def otlp(spark: SparkSession, path: str) -> DataFrame:
    return otlp_spans(spark.read.schema(OTLP).json(path))


def otlp_spans(doc: DataFrame) -> DataFrame:
    """Spans of documents parsed as OTLP; the same holds for the other formats' functions of this kind."""
    f = _file(doc)
    r = doc.select(*f, F.explode("resourceSpans").alias("r")).select(*f, _attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s"))
    x = r.select(*f, "res", F.explode("s.spans").alias("x")).withColumn("a", _attributes(F.col("x.attributes")))
    a = F.col("a")
    number = F.regexp_extract(F.col("x.kind"), r"^(\d+)$", 1).try_cast("int")
    kind = F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), number), F.lower(F.regexp_extract("x.kind", r"^SPAN_KIND_(\w+)$", 1)))
    start, end = F.col("x.startTimeUnixNano").cast("decimal(38,0)"), F.col("x.endTimeUnixNano").cast("decimal(38,0)")
    return _spans(
        x, trace_id=F.col("x.traceId"), span_id=F.col("x.spanId"), parent_id=F.nullif(F.col("x.parentSpanId"), F.lit("")), service=_first(F.col("res"), "service.name"), kind=kind,
        method=_first(a, "http.request.method", "http.method"), route=_first(a, "http.route"), path=_path(_first(a, "url.path", "http.target", "url.full", "http.url")), destination=_first(a, "messaging.destination.name", "messaging.destination"),
        at=F.timestamp_micros((start / 1000).cast("long")), status=_first(a, "http.response.status_code", "http.status_code").try_cast("int"), duration_ms=(end - start) / 1_000_000, error=F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"),
    )


def zipkin(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: a document a line, not a file."""
    return zipkin_spans(spark.read.schema(ZIPKIN).option("multiLine", not lines).json(path))


def zipkin_spans(x: DataFrame) -> DataFrame:
    tags = F.col("tags")
    return _spans(
        x, trace_id=F.col("traceId"), span_id=F.col("id"), parent_id=F.col("parentId"), service=F.col("localEndpoint.serviceName"), kind=F.lower(F.coalesce("kind", F.lit("internal"))), method=_first(tags, "http.method"), route=_first(tags, "http.route"),
        path=_path(_first(tags, "http.path", "http.url")), at=F.timestamp_micros("timestamp"), status=_first(tags, "http.status_code").try_cast("int"), duration_ms=F.col("duration") / 1000, error=F.coalesce(_first(tags, "error") != "false", F.lit(False)),
    )


def jaeger(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: a document a line, not a file."""
    return jaeger_spans(spark.read.schema(JAEGER).option("multiLine", not lines).json(path))


def jaeger_spans(doc: DataFrame) -> DataFrame:
    f = _file(doc)
    d = doc.select(*f, F.explode("data").alias("d"))
    x = d.select(*f, F.explode("d.spans").alias("x"), F.col("d.processes").alias("p")).withColumn("t", F.map_from_entries(F.transform("x.tags", lambda t: F.struct(t["key"], t["value"]))))
    t = F.col("t")
    parent = F.filter("x.references", lambda r: r["refType"] == "CHILD_OF")
    return _spans(
        x, trace_id=F.col("x.traceID"), span_id=F.col("x.spanID"), parent_id=F.try_element_at(parent, F.lit(1))["spanID"], service=F.try_element_at("p", F.col("x.processID"))["serviceName"], kind=F.coalesce(_first(t, "span.kind"), F.lit("internal")),
        method=_first(t, "http.method"), route=_first(t, "http.route"), path=_path(_first(t, "http.target", "http.url")), at=F.timestamp_micros("x.startTime"), status=_first(t, "http.status_code").try_cast("int"), duration_ms=F.col("x.duration") / 1000, error=F.coalesce(_first(t, "error") == "true", F.lit(False)),
    )


def har(spark: SparkSession, path: str) -> DataFrame:
    """Requests of browser archives (gzip by file name), each a client span of its own; a traceparent header gives trace and parent."""
    return har_spans(spark.read.schema(HAR).option("multiLine", True).json(path))


def har_spans(doc: DataFrame) -> DataFrame:
    e = doc.select(*_file(doc), F.explode("log.entries").alias("e"))
    header = F.try_element_at(F.filter("e.request.headers", lambda h: F.lower(h["name"]) == "traceparent"), F.lit(1))["value"]
    own = F.sha2(F.to_json("e"), 256)
    return _spans(
        e, trace_id=F.coalesce(F.nullif(F.regexp_extract(header, r"^\w\w-(\w{32})-", 1), F.lit("")), own), span_id=F.coalesce(F.nullif(F.regexp_extract(header, r"^\w\w-\w{32}-(\w{16})-", 1), F.lit("")), F.left(own, F.lit(16))), kind=F.lit("client"),
        method=F.upper("e.request.method"), path=_path(F.col("e.request.url")), at=F.to_timestamp("e.startedDateTime"), status=F.col("e.response.status"), duration_ms=F.col("e.time"), error=F.col("e.response.status") >= 500,
    )


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """Gateway access logs, one JSON object a line; the usual spellings of each key."""
    return access_spans(spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).filter("m is not null"))


def access_spans(m: DataFrame) -> DataFrame:
    c = F.col("m")
    when = _first(c, "requestTimeEpoch").try_cast("long")
    return _spans(
        m, trace_id=_first(c, "xrayTraceId", "requestId"), span_id=_first(c, "requestId", "extendedRequestId"), service=_first(c, "apiId", "domainName"), kind=F.lit("server"), method=F.upper(_first(c, "httpMethod", "method")),
        route=F.regexp_extract(_first(c, "resourcePath", "routeKey"), r"(/.*)$", 1), path=_path(_first(c, "path", "rawPath")), at=F.timestamp_millis(when), status=_first(c, "status").try_cast("int"), duration_ms=_first(c, "responseLatency", "integrationLatency").try_cast("double"), error=_first(c, "status").try_cast("int") >= 500,
    )


def report_log(spark: SparkSession, path: str) -> DataFrame:
    """Function REPORT lines: request id and duration."""
    return report_spans(spark.read.text(path))


def report_spans(lines: DataFrame) -> DataFrame:
    t = lines.filter(F.col("value").contains("REPORT RequestId:"))
    part = lambda p: F.regexp_extract("value", p, 1)
    return _spans(t, trace_id=part(r"RequestId: (\S+)"), span_id=part(r"RequestId: (\S+)"), kind=F.lit("server"), duration_ms=part(r"Duration: ([\d.]+) ms").try_cast("double"), error=F.col("value").rlike(r"Status: (error|timeout)"))


def csv_log(spark: SparkSession, path: str) -> DataFrame:
    """Exported log rows with @timestamp and @message columns: quoted fields may span lines."""
    c = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return c.select(F.to_timestamp(F.col("`@timestamp`")).alias("at"), F.col("`@message`").alias("message"))


def read_traces(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """Spans of files in any known format; see registry.read_any. With strict, files without one or with errors fail the call."""
    from .registry import read_any

    spans, problems = read_any(spark, paths)
    if strict and not problems.isEmpty():
        raise ValueError(f"not read: {[tuple(r) for r in problems.limit(20).collect()]}")
    return spans.drop("file", "format")
