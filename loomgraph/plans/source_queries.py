"""Readers and writers by round trips: the events written as documents of each format, read back and compared with the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import store as ST
from ..operators import telemetry as TM
from ..sources import declared as DC
from ..sources import graphs as G
from ..sources import more_traces as MT
from ..sources import registry as TF
from ..sources import traces as TR
from ..sources import views as V
from ..store import shared_dir
from .graph_queries import E, N
from .registry import query

#: What comes back of every span; times in milliseconds.
OUT = ("trace_id", "span_id", "parent_id", "service", "kind", "method", "path", "at_ms", "status", "error")
RAW_SQL = """select 't' || user_id as trace_id, 's' || event_id as span_id, case when event_id % 3 = 0 then 's' || (event_id // 2) end as parent_id, 'svc' || (user_id % 7) as service,
  'server' as kind, 'GET' as method, '/' || event_type as path, epoch_us(ts) // 1000 as at_ms, case when event_type = 'error' then 500 else 200 end as status, event_type = 'error' as error, round(value) as ms from events"""


def raw(s, d):
    """Events as flat spans, with whole milliseconds."""
    e = V.read(s, d, "events")
    n = F.col("event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.concat(F.lit("s"), n.cast("string")).alias("span_id"), F.when(n % 3 == 0, F.concat(F.lit("s"), F.floor(n / 2).cast("string"))).alias("parent_id"),
        F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"), F.lit("server").alias("kind"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), at.alias("at_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("event_type") == "error").alias("error"), F.round("value").cast("long").alias("ms"),
    )


def written(s, lines, name):
    """Lines of text in the shared folder, and their path."""
    path = f"{shared_dir(s)}/loomgraph/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def back(spans):
    return spans.select(*[F.unix_millis("at").alias(c) if c == "at_ms" else F.col(c) for c in OUT])


def attribute(key, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


@query("src_08_otlp_spans", f"select {', '.join(OUT)}, ms as duration_ms from ({RAW_SQL})")
def otlp_spans(s, d):
    """A request document for each span, one a line."""
    r = raw(s, d)
    nanos = lambda c: (c * 1_000_000).cast("string")
    attributes = F.array(attribute("http.request.method", F.col("method")), attribute("url.path", F.col("path")), attribute("http.response.status_code", F.col("status")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_id", F.lit("")).alias("parentSpanId"), F.lit("2").alias("kind"), nanos(F.col("at_ms")).alias("startTimeUnixNano"),
        nanos(F.col("at_ms") + F.col("ms")).alias("endTimeUnixNano"), attributes.alias("attributes"), F.struct(F.when(F.col("error"), "2").otherwise("0").alias("code")).alias("status"),
    )
    doc = F.struct(F.array(F.struct(F.struct(F.array(attribute("service.name", F.col("service"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    got = TR.otlp(s, written(s, r.select(F.to_json(doc).alias("value")), "otlp"))
    return got.select(*[F.unix_millis("at").alias(c) if c == "at_ms" else F.col(c) for c in OUT], "duration_ms")


@query("src_10_zipkin_spans", f"select {', '.join(OUT)} from ({RAW_SQL})")
def zipkin_spans(s, d):
    r = raw(s, d)
    tags = F.create_map(F.lit("http.method"), F.col("method"), F.lit("http.path"), F.col("path"), F.lit("http.status_code"), F.col("status").cast("string"), F.lit("error"), F.col("error").cast("string"))
    doc = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_id").alias("parentId"), F.lit("SERVER").alias("kind"), (F.col("at_ms") * 1000).alias("timestamp"), (F.col("ms") * 1000).alias("duration"), F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"), tags.alias("tags"))
    return back(TR.zipkin(s, written(s, r.select(F.to_json(doc).alias("value")), "zipkin"), lines=True))


@query("src_11_jaeger_spans", f"select {', '.join(OUT)} from ({RAW_SQL})")
def jaeger_spans(s, d):
    r = raw(s, d)
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit("string").alias("type"), v.cast("string").alias("value"))
    refs = F.when(F.col("parent_id").isNotNull(), F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_id").alias("spanID")))).otherwise(F.array().cast("array<struct<refType:string,spanID:string>>"))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.lit("p1").alias("processID"), (F.col("at_ms") * 1000).alias("startTime"), (F.col("ms") * 1000).alias("duration"), refs.alias("references"),
        F.array(tag("span.kind", F.lit("server")), tag("http.method", F.col("method")), tag("http.target", F.col("path")), tag("http.status_code", F.col("status")), tag("error", F.col("error"))).alias("tags"),
    )
    doc = F.struct(F.array(F.struct(F.col("trace_id").alias("traceID"), F.array(span).alias("spans"), F.create_map(F.lit("p1"), F.struct(F.col("service").alias("serviceName"))).alias("processes"))).alias("data"))
    return back(TR.jaeger(s, written(s, r.select(F.to_json(doc).alias("value")), "jaeger"), lines=True))


@query("src_12_archives", f"select method, path, at_ms, status, error from ({RAW_SQL})")
def archives(s, d):
    """Browser archives of a few requests each, packed as zips; every archive is opened where it lies."""
    r = raw(s, d)
    entry = F.struct(
        F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("startedDateTime"), F.col("ms").cast("double").alias("time"),
        F.struct("method", F.concat(F.lit("https://x.example.com"), "path").alias("url"), F.array().cast("array<struct<name:string,value:string>>").alias("headers")).alias("request"), F.struct("status").alias("response"),
    )
    docs = r.groupBy("trace_id", F.floor(F.xxhash64("span_id") % 50).alias("part")).agg(F.collect_list(entry).alias("entries")).select(F.concat("trace_id", F.lit("-"), F.col("part").cast("string")).alias("name"), F.to_json(F.struct(F.struct("entries").alias("log"))).alias("document"))
    got = MT.archived(MT.zipped(docs))
    return got.select("method", "path", F.unix_millis("at").alias("at_ms"), "status", "error")


@query("src_13_xray_segments", f"select trace_id, span_id, parent_id, service, method, path, at_ms, status, error from ({RAW_SQL}) union all select trace_id, span_id || 'x', span_id, 'db', null, null, at_ms, null, false from ({RAW_SQL})")
def xray_segments(s, d):
    """A segment for each span, with a subsegment for its call of a database."""
    r = raw(s, d)
    sec = lambda c: (c / 1000.0).cast("double")
    sub = F.struct(F.concat("span_id", F.lit("x")).alias("id"), F.lit("db").alias("name"), sec(F.col("at_ms")).alias("start_time"), sec(F.col("at_ms") + 1).alias("end_time"), F.lit("remote").alias("namespace"))
    doc = F.struct(
        F.col("trace_id"), F.col("span_id").alias("id"), F.col("parent_id"), F.col("service").alias("name"), sec(F.col("at_ms")).alias("start_time"), sec(F.col("at_ms") + F.col("ms")).alias("end_time"), F.col("error").alias("fault"),
        F.struct(F.struct("method", F.concat(F.lit("https://x.example.com"), "path").alias("url")).alias("request"), F.struct("status").alias("response")).alias("http"), F.array(sub).alias("subsegments"),
    )
    got = MT.xray(s, written(s, r.select(F.to_json(doc).alias("value")), "xray"))
    return got.select("trace_id", "span_id", "parent_id", "service", "method", "path", F.unix_millis("at").alias("at_ms"), "status", "error")


@query("src_14_state_machine_history", f"select trace_id, span_id, at_ms, ms as duration_ms, error from ({RAW_SQL})")
def state_machine_history(s, d):
    """An execution's events for each span: a state is entered and left, and fails in between where the span did."""
    r = raw(s, d)
    stamp = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    event = lambda i, p, kind, c: F.struct(F.lit(i).cast("long").alias("id"), F.lit(p).cast("long").alias("previousEventId"), F.lit(kind).alias("type"), stamp(c).alias("timestamp"), F.struct(F.col("span_id").alias("name")).alias("stateEnteredEventDetails"))
    end = F.col("at_ms") + F.col("ms")
    events = F.when(F.col("error"), F.array(event(1, 0, "TaskStateEntered", F.col("at_ms")), event(2, 1, "TaskFailed", end), event(3, 2, "TaskStateExited", end))).otherwise(F.array(event(1, 0, "TaskStateEntered", F.col("at_ms")), event(2, 1, "TaskStateExited", end)))
    doc = F.struct(F.concat("trace_id", F.lit("/"), "span_id").alias("executionArn"), events.alias("events"))
    got = MT.state_machine(s, written(s, r.select(F.to_json(doc).alias("value")), "sfn"))
    return got.select(F.substring_index("trace_id", "/", 1).alias("trace_id"), F.col("destination").alias("span_id"), F.unix_millis("at").alias("at_ms"), "duration_ms", "error")


@query("src_15_access_log", f"select span_id, service, method, path, at_ms, status, error from ({RAW_SQL})")
def access_log(s, d):
    doc = F.struct(F.col("span_id").alias("requestId"), F.col("service").alias("apiId"), F.col("method").alias("httpMethod"), "path", F.col("at_ms").cast("string").alias("requestTimeEpoch"), F.col("status").cast("string").alias("status"))
    got = TR.access_log(s, written(s, raw(s, d).select(F.to_json(doc).alias("value")), "access"))
    return got.select("span_id", "service", "method", "path", F.unix_millis("at").alias("at_ms"), "status", "error")


@query("src_16_report_log", f"select span_id, ms as duration_ms, error from ({RAW_SQL})")
def report_log(s, d):
    line = F.concat(F.lit("REPORT RequestId: "), "span_id", F.lit("\tDuration: "), F.col("ms").cast("string"), F.lit(".0 ms\tBilled Duration: 1 ms"), F.when(F.col("error"), "\tStatus: error").otherwise(""))
    noise = raw(s, d).select(F.concat(F.lit("START RequestId: "), "span_id").alias("value"))
    got = TR.report_log(s, written(s, raw(s, d).select(line.alias("value")).union(noise), "report"))
    return got.select("span_id", "duration_ms", "error")


@query("src_17_framework_batches", f"select {', '.join(OUT)} from ({RAW_SQL})")
def framework_batches(s, d):
    """Batches of an in-process agent: a service's records of one trace a line."""
    r = raw(s, d)
    record = F.struct(F.col("span_id").alias("id"), F.col("parent_id").alias("parent"), F.lit("handler").alias("kind"), "method", "path", F.col("at_ms").alias("start"), F.col("ms").cast("double").alias("took"), "status", F.col("error").alias("failed"))
    doc = r.groupBy("service", "trace_id").agg(F.collect_list(record).alias("records")).select(F.to_json(F.struct("service", F.col("trace_id").alias("trace"), "records")).alias("value"))
    return back(MT.framework(s, written(s, doc, "agent")))


@query("src_18_csv_rows", f"select at_ms, span_id || ', says \"' || path || '\"' || chr(10) || 'end' as message from ({RAW_SQL})")
def csv_rows(s, d):
    path = f"{shared_dir(s)}/loomgraph/csv-{uuid.uuid4().hex}"
    rows = raw(s, d).select(F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("@timestamp"), F.concat("span_id", F.lit(', says "'), "path", F.lit('"\nend')).alias("@message"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return TR.csv_log(s, path).select(F.unix_millis("at").alias("at_ms"), "message")


@query("src_07_sniffed_formats", f"select case when event_id % 3 = 0 then 'access' when event_id % 3 = 1 then 'report' else 'unknown' end as format, count(*) as documents from (select event_id from events) group by 1")
def sniffed(s, d):
    """Documents of mixed formats: the first format whose mark is in a document takes it, and the rest are told, not dropped."""
    n = V.read(s, d, "events").select("event_id")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit('{"requestId":"r'), F.col("event_id").cast("string"), F.lit('"}'))).when(k == 1, F.concat(F.lit("REPORT RequestId: r"), F.col("event_id").cast("string"))).otherwise("nothing known")
    return n.select(MT.format_of(text).alias("format")).groupBy("format").agg(F.count("*").alias("documents"))


MIXED = ("otlp", "zipkin", "jaeger", "har", "access", "report", "agent", "xray", "history", "none")


def mixed_folder(s, d):
    """A folder of files in nine formats and one of none: each event is a line of its format's files; segments are nested eight deep."""
    e = V.read(s, d, "events").select("event_id", (F.col("event_id") % 10).cast("int").alias("k"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    nanos = lambda c: (c * 1_000_000).cast("string")
    attribute_of = attribute("http.response.status_code", F.col("status"))
    micros = F.col("ms") * 1000
    segment = F.to_json(F.struct(F.concat("id", F.lit(".8")).alias("id"), F.lit("leaf").alias("name"), (F.col("ms") / 1000).alias("start_time")))
    for n in range(7, -1, -1):
        head = F.concat(F.lit('{"id":"'), "id", F.lit(f".{n}" if n else ""), F.lit('","trace_id":"t","name":"n","start_time":'), (F.col("ms") / 1000).cast("string"), F.lit(',"http":{"response":{"status":'), F.col("status").cast("string"), F.lit('}},"subsegments":['))
        segment = F.concat(head, segment, F.lit("]}"))
    texts = {
        "otlp": F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("t").alias("traceId"), F.col("id").alias("spanId"), nanos(F.col("ms")).alias("startTimeUnixNano"), nanos(F.col("ms")).alias("endTimeUnixNano"), F.array(attribute_of).alias("attributes"))).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))),
        "zipkin": F.to_json(F.array(F.struct(F.lit("t").alias("traceId"), "id", micros.alias("timestamp"), F.struct(F.lit("a").alias("serviceName")).alias("localEndpoint"), F.create_map(F.lit("http.status_code"), F.col("status").cast("string")).alias("tags")))),
        "jaeger": F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("t").alias("traceID"), F.col("id").alias("spanID"), F.lit("p").alias("processID"), micros.alias("startTime"), F.array(F.struct(F.lit("http.status_code").alias("key"), F.col("status").cast("string").alias("value"))).alias("tags"))).alias("spans"), F.create_map(F.lit("p"), F.struct(F.lit("a").alias("serviceName"))).alias("processes"))).alias("data"))),
        "har": F.concat(F.lit('{"log":{"entries":[{"startedDateTime":"'), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit('","time":1,"request":{"method":"GET","url":"https://a/x","headers":[{"name":"traceparent","value":"00-'), F.lpad("event_id", 32, "0"), F.lit("-"), F.lpad("event_id", 16, "0"), F.lit('-01"}]},"response":{"status":'), F.col("status").cast("string"), F.lit("}}]}}")),
        "access": F.to_json(F.struct(F.col("id").alias("requestId"), F.col("ms").cast("string").alias("requestTimeEpoch"), F.col("status").cast("string").alias("status"))),
        "report": F.concat(F.lit("REPORT RequestId: "), "id", F.lit(" Duration: 1.5 ms")),
        "agent": F.to_json(F.struct(F.lit("a").alias("service"), F.lit("t").alias("trace"), F.array(F.struct("id", F.col("ms").alias("start"), "status")).alias("records"))),
        "xray": segment,
        "history": F.concat(F.lit('{"executionArn":"'), "id", F.lit('","events":[{"id":1,"type":"TaskStateEntered","timestamp":"2024-01-01T00:00:00Z","stateEnteredEventDetails":{"name":"A"}}]}')),
        "none": F.concat(F.lit("nothing known "), "id"),
    }
    base = f"{shared_dir(s)}/loomgraph/mixed-{uuid.uuid4().hex}"
    for n, kind in enumerate(MIXED):
        e.filter(F.col("k") == n).select(texts[kind].alias("value")).write.text(f"{base}/{kind}")
    return base


MIXED_SQL = """with e as (select event_id, 's' || event_id as id, epoch_us(ts) // 1000 as ms, case when event_type = 'error' then 500 else 200 end as status, ['otlp', 'zipkin', 'jaeger', 'har', 'access', 'report', 'agent', 'xray', 'history', 'none'][event_id % 10 + 1] as format from events)
    select format, case format when 'har' then lpad(event_id::varchar, 16, '0') when 'history' then id || '/1' else id end as span_id, case format when 'report' then null when 'history' then 1704067200000 else ms end as at_ms, case when format not in ('report', 'history') then status end as status from e where format <> 'none'
    union all select format, id || '.' || n, ms, case when n < 8 then status end from e, range(1, 9) r(n) where format = 'xray'"""


@query("src_07_mixed_folder", MIXED_SQL)
def mixed_spans(s, d):
    """One folder of all formats read at once: the format of each file is told by its text."""
    spans, _ = TF.read_any(s, mixed_folder(s, d))
    return spans.select("format", "span_id", F.unix_millis("at").alias("at_ms"), "status")


@query("src_07_mixed_stream", MIXED_SQL)
def mixed_stream(s, d):
    """The same folder as a stream of files, five a batch, written batch by batch and read back."""
    out = TF.stream_any(s, mixed_folder(s, d), files=5)
    return s.read.parquet(f"{out}/spans").select("format", "span_id", F.unix_millis("at").alias("at_ms"), "status")


@query("src_07_unread_files", "select count(*) > 0 as found, 'no known format' as problem from events where event_id % 10 = 9")
def unread_files(s, d):
    """Files without a known format are rows with a reason."""
    _, problems = TF.read_any(s, mixed_folder(s, d))
    return problems.groupBy("problem").agg((F.count("*") > 0).alias("found"))


@query("src_20_globs", f"select pattern, count(*) as n from (values ('services/*/traces/*.json', '^services/[^/]*/traces/[^/]*\\.json$'), ('services/**/svc?.json', '^services/(.*/)?svc[^/]\\.json$'), ('**/1*.json', '^(.*/)?1[^/]*\\.json$')) g(pattern, re) join (select distinct 'services/' || service || '/traces/' || trace_id || '.json' as p from ({RAW_SQL}) union select distinct 'services/a/b/' || service || '.json' from ({RAW_SQL}) union select distinct 'x/' || user_id || '.json' from events) on regexp_matches(p, re) group by 1")
def globs(s, d):
    r = raw(s, d)
    a = r.select(F.concat(F.lit("services/"), "service", F.lit("/traces/"), "trace_id", F.lit(".json")).alias("p")).union(r.select(F.concat(F.lit("services/a/b/"), "service", F.lit(".json")))).union(V.read(s, d, "events").select(F.concat(F.lit("x/"), F.col("user_id").cast("string"), F.lit(".json")))).distinct()
    globs_ = ("services/*/traces/*.json", "services/**/svc?.json", "**/1*.json")
    hit = F.filter(F.array(*[F.when(MT.path_glob(F.col("p"), g), g) for g in globs_]), lambda x: x.isNotNull())
    return a.select(F.explode(hit).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query("src_06_graph_documents", f"with n as {N}, e as {E} select 'nodes' as what, count(*) as n from n union all select 'edges', count(*) from e where type in ('in_region', 'based_in', 'lives_in')")
def graph_documents(s, d):
    """A document for each service's nodes and one for the edges of each type, read as one graph."""
    n = V.nodes(s, d).groupBy("service", "type", F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.collect_list(F.struct("id", "type", "kind", "label", "service")).alias("nodes"))
    edges = V.edges(s, d).filter("type in ('in_region', 'based_in', 'lives_in')")
    e = edges.groupBy("type", F.pmod(F.xxhash64("from_id"), F.lit(64)).alias("p")).agg(F.collect_list(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "type", "confidence")).alias("edges"))
    path = written(s, n.select(F.to_json(F.struct("nodes")).alias("value")).union(e.select(F.to_json(F.struct("edges")).alias("value"))), "graph")
    g = G.read_graph(s, path, lines=True)
    return g["nodes"].agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).union(g["edges"].agg(F.lit("edges"), F.count("*")))


@query("src_22_upgraded_traffic", f"select path as id, epoch_ms(date_trunc('hour', max(make_timestamp(at_ms * 1000)))) as hour_ms, count(*) as count, 3 as format from ({RAW_SQL}) group by 1")
def upgraded_traffic(s, d):
    """Traffic as the first format stored it: no hours, errors or histograms."""
    old = raw(s, d).groupBy(F.col("path").alias("id")).agg(F.count("*").alias("count"), F.timestamp_millis(F.max("at_ms")).alias("last_seen")).withColumn("family", F.lit("entry"))
    return G.upgrade_observed(old).select("id", F.unix_millis("hour").alias("hour_ms"), "count", "format")


@query("snk_02_replaced_service", f"with n as {N} select coalesce(service, 'none') as service, count(*) as n, count(*) filter (label like '%!') as changed from (select service, case when service = 'ASIA' then label || '!' else label end as label from n) group by 1")
def replaced_service(s, d):
    """A store is written, one service's rows are replaced, and the store is opened again."""
    path = f"{shared_dir(s)}/loomgraph/store-{uuid.uuid4().hex}"
    n = V.nodes(s, d).withColumn("service", F.coalesce("service", F.lit("none")))
    ST.write_store({"nodes": n}, path)
    changed = ST.open_store(s, path, ("nodes",))["nodes"].filter("service = 'ASIA'").withColumn("label", F.concat("label", F.lit("!")))
    ST.replace_service({"nodes": ST.materialise(changed, "changed")}, path, "ASIA")
    now = ST.open_store(s, path, ("nodes",))["nodes"]
    return now.groupBy("service").agg(F.count("*").alias("n"), F.count_if(F.col("label").endswith("!")).alias("changed"))


@query("snk_01_stored_counts", f"with n as {N}, e as {E} select 'nodes' as what, type, count(*) as n from n group by 2 union all select 'edges', type, count(*) from e group by 2 union all select 'types', 'object', count(*) from ({DC.TYPES_SQL}) union all select 'unresolved', level, count(*) from ({DC.UNRESOLVED_SQL}) group by 2")
def stored_counts(s, d):
    """SRC-01 and SNK-01: the four tables written and opened."""
    path = f"{shared_dir(s)}/loomgraph/store-{uuid.uuid4().hex}"
    ST.write_store({"nodes": V.nodes(s, d), "edges": V.edges(s, d), "types": DC.types(s, d), "unresolved": DC.unresolved(s, d)}, path)
    g = ST.open_store(s, path)
    out = None
    for name, by in (("nodes", "type"), ("edges", "type"), ("types", "kind"), ("unresolved", "level")):
        part = g[name].groupBy(F.col(by).alias("type")).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "type", "n")
        out = part if out is None else out.union(part)
    return out


@query("str_10_late_rows", f"with x as (select path as entry, make_timestamp(at_ms * 1000) as \"at\" from ({RAW_SQL})) select date_trunc('hour', \"at\") as hour, entry, count(*) as n from x group by 1, 2")
def late_rows(s, d):
    """Late rows go to their own hour: batches out of order are merged as partials, so the order they come in makes no difference."""
    r = raw(s, d).select(F.col("path").alias("entry"), F.timestamp_millis("at_ms").alias("at"), "status", F.col("ms").cast("double").alias("duration_ms"), "error", F.xxhash64("span_id").alias("h"))
    hours = r.withColumn("hour", F.date_trunc("hour", "at"))
    late, soon = hours.filter("h % 4 = 0"), hours.filter("h % 4 <> 0")
    both = TM.merge(TM.partials(soon, ["hour", "entry"]).unionByName(TM.partials(late, ["hour", "entry"])), ["hour", "entry"])
    return both.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "entry", F.col("count").alias("n"))
