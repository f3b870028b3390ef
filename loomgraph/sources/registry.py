"""Trace files of any known format from one place: each is told by its whole text inside the task, and none is left out.

Files are read by Spark, so any store will do; a helper unpacks gzip files and zip archives, plain ones stay in the JVM. A text that is one JSON value over
several lines is one document, else each of its lines is. Long plain files are read by their lines in as many tasks as they have
splits, and only files of other kinds are a value each. Documents are parsed in the JVM by their format's schema, all files of a format in one plan, so the
number of jobs is that of formats, not of files. What has no format, can't be unpacked or gives no span comes as a row with a reason.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..store import LONG_ROWS, importable, materialise, shared_dir, sized
from . import more_traces as M
from . import traces as T

#: Bytes of an archive's member, unpacked, at most; larger ones are told, not read.
MEMBER = 256 << 20
#: Bytes of a plain file that is held as one value, at most; a longer one is read by its lines, unless it is one JSON value over several.
WHOLE = 1 << 20
#: Endings of names that Spark's text reader unpacks of its own accord; such files go by their content, as all others do.
ENDINGS = r"(?i)\.(bz2|deflate|gz|lz4|snappy|zst)$"
BOM = "\ufeff"
FILES = "file string, text string, problem string"
#: What a text of exported log rows has, wherever.
CSV_MARKS = ('"@message"', '"@timestamp"')


def _json(schema: str, spans: Callable[[DataFrame], DataFrame], lists: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A reader of documents (file, text) that parses them by a schema; lists: a document may be a list of such values."""
    def read(docs: DataFrame) -> DataFrame:
        if lists:
            many = F.from_json("text", ArrayType(StructType.fromDDL(schema)))  # one value is a list of one
            return spans(docs.select("file", F.explode(many).alias("d")).select("file", "d.*"))
        return spans(docs.select("file", F.from_json("text", schema).alias("d")).select("file", "d.*"))

    return read


def _csv(docs: DataFrame) -> DataFrame:
    """Exported log rows: a message that is a REPORT line or an access log's object is read as that."""
    message = F.try_variant_get(F.try_parse_json("text"), "$['@message']", "string")
    rows = docs.select("file", message.alias("value"))
    access = rows.select("file", F.from_json("value", "map<string,string>").alias("m")).filter("m is not null and map_contains_key(m, 'requestId')")
    return T.report_spans(rows).unionByName(T.access_spans(access))


#: The reader of each format, in the order in which marks are asked.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "otlp": _json(T.OTLP, T.otlp_spans), "jaeger": _json(T.JAEGER, T.jaeger_spans), "har": _json(T.HAR, T.har_spans), "zipkin": _json(T.ZIPKIN, T.zipkin_spans, lists=True),
    "history": _json(M.HISTORY, M.history_spans), "agent": _json(M.BATCH, M.framework_spans), "csv": _csv,
    "xray": lambda docs: M.xray_spans(docs.select("file", F.try_parse_json("text").alias("v"))),
    "report": lambda docs: T.report_spans(docs.select("file", F.col("text").alias("value"))),
    "access": lambda docs: T.access_spans(docs.select("file", F.from_json("text", "map<string,string>").alias("m")).filter("m is not null")),
}


def _unpacked(name: str, raw: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    """(file, text, problem) of a file, or of each member of an archive."""
    try:
        if raw[:2] == b"\x1f\x8b":
            yield name, gzip.decompress(raw).decode("utf-8", "replace"), None
        elif raw[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for m in z.infolist():
                    if m.is_dir():
                        continue
                    if m.file_size > MEMBER:
                        yield f"{name}!{m.filename}", None, "too large"
                    else:
                        yield from _unpacked(f"{name}!{m.filename}", z.read(m))
        else:
            text = raw.decode("utf-8", "replace")
            head = text.lstrip("﻿").split("\n", 1)[0]
            if "@timestamp" in head and "@message" in head and not head.lstrip().startswith("{"):
                rows = csv.DictReader(io.StringIO(text.lstrip("﻿"), newline=""))
                text = "\n".join(json.dumps(r) for r in rows)
            yield name, text, None
    except (OSError, EOFError, zipfile.BadZipFile, ValueError) as e:
        yield name, None, f"unreadable: {type(e).__name__}"


def needs_unpacking() -> Column:
    """Whether content is gzip, an archive or rows of an exported log: only these go to the helper."""
    head = F.substring_index(F.col("content").cast("string"), "\n", 1)
    rows = F.contains(head, F.lit("@timestamp")) & F.contains(head, F.lit("@message")) & ~head.rlike("^[\\s\ufeff]*\\{")
    return F.coalesce((F.substring("content", 1, 2) == F.lit(b"\x1f\x8b")) | (F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")) | rows, F.lit(False))


def unpacked(files: DataFrame) -> DataFrame:
    """files (path, content) as (file, text, problem); one file is one value, as long as it is. Plain text never leaves the JVM."""
    plain = files.filter(~needs_unpacking()).select(F.col("path").alias("file"), F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit("")).alias("text"), F.lit(None).cast("string").alias("problem"))
    return plain.unionByName(_by_helper(files.filter(needs_unpacking())))


def _by_helper(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in _unpacked(name, raw.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["file", "text", "problem"])

    importable(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, FILES)


def told(texts: DataFrame) -> DataFrame:
    """texts (file, text, problem) with `format`: the first whose mark is anywhere in the text, else null."""
    csv_mark = F.col("text").contains(CSV_MARKS[0]) & F.col("text").contains(CSV_MARKS[1])
    marks = F.coalesce(*[F.when(F.col("text").contains(mark), name) for name, mark in M.MARKS])
    return texts.withColumn("format", F.when(csv_mark, "csv").otherwise(marks))


def opened(line: Column) -> Column:
    """Brackets that a line opens less those it closes: a JSON value over several lines opens some in the first and is at 0 after the last."""
    bare = F.regexp_replace(line, r'(?s)"(?:[^"\\]|\\.)*+"?', "")  # without strings, whose line breaks are escaped
    return F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))


def documents(texts: DataFrame) -> DataFrame:
    """(file, format, text): one row a document of files with a format."""
    text = F.ltrim(F.col("text"), F.lit(BOM))
    first = F.regexp_extract(text, r"^\s*([^\n]*)", 1)
    # in brackets, as what follows a first value isn't looked at otherwise
    whole = (F.col("format") != "csv") & (opened(first) > 0) & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    each = F.explode(F.when(whole, F.array(text)).otherwise(F.split(text, "\r?\n")))
    return texts.filter("format is not null").select("file", "format", each.alias("text")).filter(F.trim("text") != "")


def _files(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """Files under the paths by one of Spark's readers, with `key`, `name` and `size`: filters on these leave files out before they are opened."""
    f = spark.read.format(kind).options(recursiveFileLookup=True, lineSep="\n").load(list(paths))
    return f.select("*", *[F.col(f"_metadata.file_{c}").alias(k) for k, c in (("key", "path"), ("name", "name"), ("size", "size"))])


def _by_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(key, top, n, content, text): the lines of long files, in their order by n; top: in the split that a file begins with."""
    rows = _files(spark, paths, "text").filter((F.col("size") > WHOLE) & ~F.col("name").rlike(ENDINGS))
    text = F.ltrim(F.rtrim(F.make_valid_utf8("value"), F.lit("\r")), F.lit(BOM))
    return rows.select("key", (F.col("_metadata.file_block_start") == 0).alias("top"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("content"), text.alias("text"))


def _heads(lines: DataFrame) -> DataFrame:
    """A row a long file: (key, format, held, empty); held: packed, exported rows, or lines that may be one JSON value only together."""
    def at_first(when: Column, test: Column) -> Column:  # the test of the first line of a file for which `when` holds
        least = F.min(F.when(F.col("top") & when, F.col("n") * 2 + F.coalesce(test, F.lit(False)).cast("long")))
        return F.coalesce(least % 2 == 1, F.lit(False))

    has, more = F.col("text").rlike(r"\S"), F.col("opened")
    mark = F.coalesce(*[F.when(F.col("text").contains(m), i) for i, (_, m) in enumerate(M.MARKS)])
    facts = lines.withColumn("opened", opened(F.col("text"))).groupBy("key").agg(
        F.min(mark).alias("mark"), *[F.bool_or(F.col("text").contains(m)).alias(f"csv{i}") for i, m in enumerate(CSV_MARKS)], (~F.bool_or(has)).alias("empty"),
        (at_first(F.lit(True), needs_unpacking()) | at_first(has, more > 0) & (F.sum(more) == 0)).alias("held"),
    )
    name = F.try_element_at(F.array(*[F.lit(n) for n, _ in M.MARKS]), F.col("mark") + 1)
    return facts.select("key", F.when(F.col("csv0") & F.col("csv1"), "csv").otherwise(name).alias("format"), "held", "empty")


def parsed(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(spans with file and format, problems (file, format, problem)) of the files under the paths."""
    lines, files = _by_lines(spark, paths), _files(spark, paths, "binaryFile")
    named = files.filter(F.col("size") > WHOLE).select("key", F.col("path").alias("file")).distinct()
    heads = materialise(_heads(lines).join(named, "key"), "trace-heads")
    held = [r[0] for r in heads.filter("held").select("key").collect()]  # names of files, as the readers' plans hold them
    single = files.filter((F.col("size") <= WHOLE) | F.col("name").rlike(ENDINGS) | F.col("key").isin(held))
    texts = materialise(told(unpacked(single.select("path", "content"))), "trace-texts", **LONG_ROWS)
    rest = heads.filter("not held")
    split = lines.join(sized(rest.filter("format is not null"), heads.count(), 500), "key").filter(F.trim("text") != "").select("file", "format", "text")
    docs = materialise(documents(texts).unionByName(split), "trace-documents", **LONG_ROWS)
    found = [r[0] for r in docs.select("format").distinct().collect()]  # a row a format
    parts = [READERS[k](docs.filter(F.col("format") == k).select("file", "text")).withColumn("format", F.lit(k)) for k in READERS if k in found]
    empty = T._spans(docs.select("file").limit(0)).withColumn("format", F.lit(None).cast("string"))
    spans = materialise(reduce(DataFrame.unionByName, parts, empty), "trace-spans")
    seen = texts.select("file", "format", "problem", F.coalesce("text", F.lit("")).rlike(r"^\s*$").alias("empty")).unionByName(rest.select("file", "format", F.lit(None).cast("string").alias("problem"), "empty"))
    none = seen.join(spans.select("file").distinct(), "file", "left_anti")
    why = F.coalesce("problem", F.when(F.col("empty"), "empty").when(F.col("format").isNull(), "no known format").otherwise("no span in it"))
    return spans, none.select("file", "format", why.alias("problem"))


def read_any(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(spans with file and format, problems) of all files under the paths: folders, globs or files, of any format.

    Every file is in one of both, but those of no bytes, which Spark's reader doesn't list. Spans are as in schema.SPANS. Blank
    files, unknown formats, files that can't be unpacked and files without a span
    are problems; a line of a file that can't be parsed gives no span.
    """
    own = [paths] if isinstance(paths, str) else list(paths)
    return parsed(spark, own)


def stream_any(spark: SparkSession, path: str, out: str | None = None, files: int = 100) -> str:
    """A stream over the files of a folder, run until it has all of them: spans and problems are appended under `out`, which is returned.

    Each batch of at most `files` new files is parsed as read_any does and written under its number; a batch that is run again
    overwrites itself, and files that came before aren't read again when the stream is started anew with the same `out`.
    """
    base = out or f"{shared_dir(spark)}/loomgraph/traces-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a file's own path isn't a pattern, whatever its name
        spans, problems = parsed(batch.sparkSession, [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in batch.collect()])
        spans.write.mode("overwrite").parquet(f"{base}/spans/batch={number}")
        problems.write.mode("overwrite").parquet(f"{base}/problems/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(path).select("path")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return base
