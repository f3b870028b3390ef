"""Further trace formats: nested segments, state machine histories, agent batches and zipped archives; formats told by their marks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import importable, materialise
from .traces import HAR, _file, _path, _spans

_PART = (
    "struct<id:string,parent_id:string,trace_id:string,name:string,namespace:string,start_time:double,end_time:double,fault:boolean,"
    "http:struct<request:struct<method:string,url:string>,response:struct<status:int>>,subsegments:array<variant>>"
)


def xray(spark: SparkSession, path: str) -> DataFrame:
    """Segments, one JSON object a line, and their subsegments to any depth."""
    return xray_spans(spark.read.text(path).select(F.try_parse_json("value").alias("v")))


def xray_spans(doc: DataFrame) -> DataFrame:
    """Spans of segments (v, a VARIANT) and of all that is nested in them, each under its parent.

    A level is one explode of the level above, written before the next one; the parent's id and trace go along. It ends with the
    deepest segment, whatever its depth.
    """
    f = _file(doc)
    level = doc.select(*f, F.try_variant_get("v", "$", _PART).alias("s")).filter("s.id is not null")
    level, out = level.select(*f, "s", F.col("s.trace_id").alias("trace"), F.col("s.parent_id").alias("parent"), F.lit(True).alias("top")), None
    while True:
        level = materialise(level, "segments")
        if out is not None and level.isEmpty():
            return out
        s = F.col("s")
        millis = lambda c: F.timestamp_millis(F.round(c * 1000).cast("long"))
        fault = F.coalesce(s["fault"], F.lit(False)) | F.coalesce(s["http"]["response"]["status"] >= 500, F.lit(False))
        kind = F.when(F.col("top"), "server").when(s["namespace"].isin("remote", "aws"), "client").otherwise("internal")
        rows = _spans(
            level, trace_id=F.col("trace"), span_id=s["id"], parent_id=F.col("parent"), service=s["name"], kind=kind, method=s["http"]["request"]["method"], path=_path(s["http"]["request"]["url"]),
            destination=F.when(kind == "client", s["name"]), at=millis(s["start_time"]), status=s["http"]["response"]["status"], duration_ms=F.round((s["end_time"] - s["start_time"]) * 1000, 3), error=fault,
        )
        out = rows if out is None else out.unionByName(rows)
        below = level.select(*f, F.explode("s.subsegments").alias("v"), "trace", F.col("s.id").alias("parent"))
        level = below.select(*f, F.try_variant_get("v", "$", _PART).alias("s"), "trace", "parent", F.lit(False).alias("top")).filter("s is not null")


HISTORY = "executionArn string, events array<struct<id:long,previousEventId:long,type:string,timestamp:string,stateEnteredEventDetails:struct<name:string>>>"


def state_machine(spark: SparkSession, path: str) -> DataFrame:
    """Histories of executions, one a line: a span for each state, from entered to exited; failed if something between failed.

    A state's end is the next exit of that name in the execution; all of an execution's events are one row's array, so no shuffle.
    """
    return history_spans(spark.read.schema(HISTORY).json(path))


def history_spans(doc: DataFrame) -> DataFrame:
    f = _file(doc)
    doc = doc.withColumn("e", F.array_sort(F.transform("events", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["timestamp"].alias("at"), x["stateEnteredEventDetails"]["name"].alias("name")))))
    entered = doc.select(*f, "executionArn", "e", F.explode(F.filter("e", lambda x: x["type"].endswith("StateEntered"))).alias("s"))
    after = F.filter("e", lambda x: x["id"] > F.col("s")["id"])
    end = F.try_element_at(F.filter(after, lambda x: x["type"].endswith("StateExited") & x["name"].eqNullSafe(F.col("s")["name"])), F.lit(1))
    met = entered.withColumn("end", end).withColumn("bad", F.exists(after, lambda x: x["type"].rlike("(Failed|TimedOut|Aborted)$") & (F.col("end").isNull() | (x["id"] < F.col("end")["id"]))))
    at, to = F.to_timestamp("s.at"), F.to_timestamp("end.at")
    return _spans(
        met, trace_id=F.col("executionArn"), span_id=F.concat_ws("/", "executionArn", F.col("s.id").cast("string")), kind=F.lit("internal"), service=F.regexp_extract("executionArn", r"([^:/]+)(?:[:/][^:/]*)?$", 1),
        destination=F.col("s.name"), at=at, duration_ms=(F.unix_millis(to) - F.unix_millis(at)), error=F.col("bad"),
    )


BATCH = "service string, trace string, records array<struct<id:string,parent:string,kind:string,method:string,path:string,start:long,took:double,status:int,failed:boolean>>"


def framework(spark: SparkSession, path: str) -> DataFrame:
    """Batches of an in-process agent, one a line: handlers are server spans, clients client spans, all else internal."""
    return framework_spans(spark.read.schema(BATCH).json(path))


def framework_spans(doc: DataFrame) -> DataFrame:
    r = doc.select(*_file(doc), "service", "trace", F.explode("records").alias("r"))
    kind = F.when(F.col("r.kind").isin("handler", "request"), "server").when(F.col("r.kind").isin("client", "fetch"), "client").otherwise("internal")
    return _spans(
        r, trace_id=F.col("trace"), span_id=F.col("r.id"), parent_id=F.col("r.parent"), service=F.col("service"), kind=kind, method=F.upper("r.method"), path=_path(F.col("r.path")), at=F.timestamp_millis("r.start"),
        status=F.col("r.status"), duration_ms=F.col("r.took"), error=F.coalesce("r.failed", F.lit(False)),
    )


#: Characters of unpacked members that are handed on at once, about: a batch a member costs more than its unpacking.
HELD = 4 << 20


def zipped(docs: DataFrame) -> DataFrame:
    """docs (name, document) as zip archives (name, content), one each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{name}.har", text)
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["name", "content"])

    importable(docs.sparkSession)
    return docs.select("name", "document").mapInArrow(run, "name string, content binary")


def unzipped(archives: DataFrame, ending: str = ".har", most: int = 64 << 20) -> DataFrame:
    """(member, document) of the members of archives (name, content) with that ending; a member over `most` bytes fails the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held = [], [], 0
        for b in batches:
            for raw in b.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for m in z.infolist():
                        if m.filename.lower().endswith(ending):
                            if m.file_size > most:
                                raise ValueError(f"{m.filename} has {m.file_size} bytes")
                            names.append(m.filename)
                            texts.append(z.read(m).decode("utf-8", "replace"))
                            held += len(texts[-1])
                            if held >= HELD or len(names) == 4096:
                                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["member", "document"])
                                names, texts, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["member", "document"])

    importable(archives.sparkSession)
    return archives.select("content").mapInArrow(run, "member string, document string")


def archived(archives: DataFrame) -> DataFrame:
    """Requests of the browser archives in zips, as client spans."""
    doc = unzipped(archives).select(F.from_json("document", HAR).alias("d")).select(F.explode("d.log.entries").alias("e"))
    own = F.sha2(F.to_json("e"), 256)
    return _spans(
        doc, trace_id=own, span_id=F.left(own, F.lit(16)), kind=F.lit("client"), method=F.upper("e.request.method"), path=_path(F.col("e.request.url")), at=F.to_timestamp("e.startedDateTime"), status=F.col("e.response.status"),
        duration_ms=F.col("e.time"), error=F.col("e.response.status") >= 500,
    )


#: Marks of formats, in the order in which they are asked; a document without any is of none.
MARKS = (("otlp", '"resourceSpans"'), ("jaeger", '"processes"'), ("har", '"entries"'), ("zipkin", '"localEndpoint"'), ("history", '"executionArn"'), ("agent", '"records"'), ("xray", '"subsegments"'), ("report", "REPORT RequestId:"), ("access", '"requestId"'))


def format_of(text: Column) -> Column:
    """The first format whose mark is in a document, else "unknown": told, not left out."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(mark)), name) for name, mark in MARKS], F.lit("unknown"))


def path_glob(path: Column, pattern: str) -> Column:
    """Whether a path fits: "*" and "?" within a segment, "**/" any number of them."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return path.rlike(f"^{out}$")
