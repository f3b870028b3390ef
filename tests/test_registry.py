"""A mixed folder of trace files, packed and not, as batch and stream; nothing is left out."""

import gzip
import io
import json
import os
import zipfile

import pytest

from loomgraph.sources import registry as R
from loomgraph.sources.traces import read_traces


def segment(depth):
    s = {"id": f"x{depth}", "trace_id": "t", "name": "n", "start_time": 1.0, "end_time": 2.0}
    return s | {"subsegments": [segment(depth - 1)]} if depth else s


ZIPKIN = [{"traceId": "t", "id": "z1", "localEndpoint": {"serviceName": "s"}, "timestamp": 1000}, {"traceId": "t", "id": "z2", "localEndpoint": {"serviceName": "s"}}]
HAR = {"log": {"entries": [{"startedDateTime": "2024-01-01T00:00:00Z", "time": 1, "request": {"method": "GET", "url": "https://a/x", "headers": [{"name": "traceparent", "value": f"00-{'a' * 32}-{'b' * 16}-01"}]}, "response": {"status": 503}}]}}
FILES = {
    "zipkin.json": json.dumps(ZIPKIN, indent=1), "lines.json": "\n".join(json.dumps(x) for x in ZIPKIN).replace("z", "y"), "deep.log": json.dumps(segment(12)) + "\nnot json\n",
    "late.json": '{"pad":"' + "p" * 70000 + '","log":' + json.dumps(HAR["log"]) + "}", "report.log": "START\nREPORT RequestId: r1 Duration: 2.5 ms\nREPORT RequestId: r2 Duration: 1 ms\n",
    "rows.csv": '@timestamp,@message\n2024-01-01,"REPORT RequestId: r3\nDuration: 4 ms"\n2024-01-01,"{""requestId"":""q1"",""status"":""502""}"\n', "empty.json": " \n", "odd.txt": "hello", "bare.json": '{"resourceSpans":[]}',
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, text in FILES.items():
        (tmp_path / "in" / n).write_text(text)
    (tmp_path / "in" / "sub" / "a.har.gz").write_bytes(gzip.compress(json.dumps(HAR).encode()))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("m/1.json", json.dumps(HAR))
        z.writestr("m/2.txt", "nothing")
    (tmp_path / "in" / "sub" / "b.zip").write_bytes(raw.getvalue())
    (tmp_path / "in" / "broken.gz").write_bytes(b"\x1f\x8bxx")
    return str(tmp_path / "in")


def short(rows):
    return sorted((r.file.split("/in/")[1], *tuple(r)[1:]) for r in rows)


SPANS = sorted([("zipkin.json", "zipkin", "z1"), ("zipkin.json", "zipkin", "z2"), ("lines.json", "zipkin", "y1"), ("lines.json", "zipkin", "y2"), *[("deep.log", "xray", f"x{k}") for k in range(13)], ("late.json", "har", "b" * 16), ("report.log", "report", "r1"), ("report.log", "report", "r2"), ("rows.csv", "csv", "r3"), ("rows.csv", "csv", "q1"), ("sub/a.har.gz", "har", "b" * 16), ("sub/b.zip!m/1.json", "har", "b" * 16)])
PROBLEMS = sorted([("bare.json", "no span in it"), ("broken.gz", "unreadable: BadGzipFile"), ("empty.json", "empty"), ("odd.txt", "no known format"), ("sub/b.zip!m/2.txt", "no known format")])


def test_every_file_is_told(spark, folder):
    spans, problems = R.read_any(spark, folder)
    assert short(spans.select("file", "format", "span_id").collect()) == SPANS
    told = short(problems.select("file", "problem").collect())
    assert [(f, p.replace("EOFError", "BadGzipFile")) for f, p in told] == PROBLEMS
    parents = {r.span_id: r.parent_id for r in spans.filter("format = 'xray'").collect()}
    assert parents == {f"x{k}": f"x{k + 1}" if k < 12 else None for k in range(13)}
    with pytest.raises(ValueError):
        read_traces(spark, [folder], strict=True)


def test_a_stream_reads_the_same(spark, folder, tmp_path):
    out = R.stream_any(spark, folder, str(tmp_path / "out"), files=3)
    assert short(spark.read.parquet(f"{out}/spans").select("file", "format", "span_id").collect()) == SPANS
    (tmp_path / "in" / "more.log").write_text("REPORT RequestId: r9 Duration: 2.5 ms")
    R.stream_any(spark, folder, out, files=3)
    again = short(spark.read.parquet(f"{out}/spans").select("file", "format", "span_id").collect())
    assert again == sorted([*SPANS, ("more.log", "report", "r9")])


def test_no_files_with_spans(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    spans, problems = R.read_any(spark, str(tmp_path / "x.txt"))
    assert spans.count() == 0 and problems.count() == 1


def test_plain_files_stay_in_the_jvm(spark):
    raw = [b"", b"plain\n{}", b"\xff\xfea\xe2\x82", b"\xed\xa0\x80\xf0\x9f\x98x\xc0\xaf", b"\xef\xbb\xbf{\"@timestamp\": \"@message\"}", b"PK", b"\x1f", "é\n".encode() * 9, None]
    packed = [gzip.compress(b"x"), b"@timestamp,@message\n1,a\n"]
    files = spark.createDataFrame([(str(i), x) for i, x in enumerate(raw + packed)], "path string, content binary")
    seen = {r.path for r in files.filter(R.needs_unpacking()).collect()}
    assert seen == {str(len(raw)), str(len(raw) + 1)}
    got = {r.file: (r.text, r.problem) for r in R.unpacked(files).collect()}
    assert [got[str(i)] for i in range(len(raw))] == [((x or b"").decode("utf-8", "replace"), None) for x in raw]
    assert got[str(len(raw))] == ("x", None) and json.loads(got[str(len(raw) + 1)][0]) == {"@timestamp": "1", "@message": "a"}


LINES = [json.dumps(x) for x in (ZIPKIN[0] | {"id": f"l{i}"} for i in range(3000))]
ODD = {
    "a b%20[1]*?{x}é.jsonl": "﻿" + "\r\n".join([*LINES[:1000], "not json", "", " ", *LINES[1000:2000]]),
    "commas.txt": ",\n".join(LINES[:300]), "later.json": "\n \n\n" + json.dumps(ZIPKIN, indent=1), "none.txt": "[a] {\n" * 200, "cut.log": '{"a": [{\n' + "\n".join(LINES[2000:2500]), "even.txt": "[a {\n}]\n" * 200, "[b] log": "[b] REPORT RequestId: b1 Duration: 1 ms\n" + "[c\n" * 50, "blank": " \n\t\r\n" * 20,
    "named.gz.json": "[1,\n" * 9 + LINES[0], "plain.gz": LINES[2999],
}


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_files_of_lines_are_never_one_value(spark, folder, tmp_path, monkeypatch, whole):
    from pyspark.sql import functions as F

    from loomgraph.store import shared_dir

    monkeypatch.setattr(R, "WHOLE", whole, raising=False)
    for n, text in ODD.items():
        (tmp_path / "in" / n).write_bytes(text.encode())
    (tmp_path / "in" / "badly.har.log").write_bytes(b"\xff\xfe\n" + json.dumps(HAR).encode() + b"\n\xe2\x82\n")
    names = list(ODD)
    more = [(names[0], "zipkin", f"l{i}") for i in range(2000)] + [("commas.txt", "zipkin", f"l{i}") for i in range(300)] + [("cut.log", "zipkin", f"l{i}") for i in range(2000, 2500)] + [("later.json", "zipkin", "z1"), ("later.json", "zipkin", "z2"), ("[b] log", "report", "b1"), ("named.gz.json", "zipkin", "l0"), ("plain.gz", "zipkin", "l2999"), ("badly.har.log", "har", "b" * 16)]
    made = lambda: set(os.listdir(f"{shared_dir(spark)}/loomgraph"))
    before = made() if os.path.exists(f"{shared_dir(spark)}/loomgraph") else set()
    spans, problems = R.read_any(spark, folder)
    held = {x for x in made() - before if x.startswith("trace-texts")}
    assert short(spans.select("file", "format", "span_id").collect()) == sorted(SPANS + more)
    told = short(problems.select("file", "problem").collect())
    assert [(f, p.replace("EOFError", "BadGzipFile")) for f, p in told] == sorted([*PROBLEMS, ("none.txt", "no known format"), ("even.txt", "no known format"), ("blank", "empty")])
    texts = spark.read.parquet(*[f"{shared_dir(spark)}/loomgraph/{x}" for x in held]).select(F.regexp_extract("file", "/in/(.*)", 1)).collect()
    if not whole:  # packed, exported rows or a value over several lines
        assert {r[0] for r in texts} == {"zipkin.json", "later.json", "rows.csv", "plain.gz", "broken.gz", "sub/a.har.gz", "sub/b.zip!m/1.json", "sub/b.zip!m/2.txt", "even.txt"}
    out = R.stream_any(spark, folder, str(tmp_path / "out"), files=7)
    assert short(spark.read.parquet(f"{out}/spans").select("file", "format", "span_id").collect()) == sorted(SPANS + more)
    assert len(spark.read.parquet(f"{out}/problems").collect()) == len(told)
