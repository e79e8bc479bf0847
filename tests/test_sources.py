"""File readers on small files written here, sinks, and the event consumer's rules."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks
from millrace.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "deep").mkdir()
    (root / "deep" / "with_title.md").write_text("intro\n# The Title\nbody")
    (root / "no_title.md").write_text("only body")
    (root / "blank.md").write_text(" \n")
    (root / "a_note.txt").write_text("line one\nline two")
    (root / "one.json").write_text('{"name": "N", "b": 1, "a": [2]}')
    (root / "ingestion_manifest.json").write_text("{}")
    (root / "t.csv").write_text('id,feature,body\n1,"x, y","two\nlines"\n2,,\n')
    (root / "my_openapi.yaml").write_text("paths:\n  /a:\n    get: {summary: Read, tags: [t]}\n    post: {}\n")
    (root / "rows.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    para = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{para('one')}{para('')}{para('two')}<w:tbl><w:tr>{cell('l')}{cell('r')}</w:tr></w:tbl></w:body></w:document>")
    (root / "broken.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(root / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><t>n</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/charts/chart1.xml", "<chartSpace><chart><title><t>Sales</t></title><barChart><f>S!A1:A2</f></barChart></chart></chartSpace>")
    return str(root)


def test_texts(spark, folder):
    assert {(r.title, r.content) for r in files.markdown(spark, folder).collect()} == {("The Title", "intro\n# The Title\nbody"), ("No Title", "only body")}
    assert [(r.title, r.content) for r in files.plain(spark, folder).collect()] == [("A Note", "line one\nline two")]
    (found,) = files.json_files(spark, folder).collect()
    assert found.title == "N" and list(json.loads(found.content)) == ["a", "b", "name"]


def test_rows(spark, folder):
    found = {r.title: r for r in files.csv_rows(spark, folder).collect()}
    assert found["1"].features == ["x", "y"] and found["1"].metadata["body"] == "two\nlines"
    assert found["2"].content == "id: 2" and found["2"].metadata["body"] == ""
    assert sorted(r.a for r in files.jsonl(spark, f"{folder}/rows.jsonl", "a int").collect()) == [1, 2]
    assert files.digests(spark, f"{folder}/rows.jsonl").first().length == 18
    assert {r.title: r.features for r in files.openapi(spark, folder).collect()} == {"GET /a": ["t"], "POST /a": []}


def test_office(spark, folder):
    unreadable = [r for r in files.docx(spark, folder).collect() if r.source_type == "unreadable"]
    assert [r.content for r in unreadable] == ["BadZipFile: File is not a zip file"]
    found = {r.content: r.metadata for r in files.docx(spark, folder).where("source_type <> 'unreadable'").collect()}
    assert set(found) == {"one", "two", "l | r"} and found["one"]["next"] == "two" and "previous" not in found["one"]
    assert [(r.content, r.metadata["excel_row_number"]) for r in files.xlsx_rows(spark, folder).collect()] == [("name: Ann\nn: 7", "2")]
    assert [(r.title, r.metadata["type"]) for r in files.xlsx_charts(spark, folder).collect()] == [("Sales", "barChart")]
    assert files.recognised(spark, folder, "*.docx", lambda b: [str(len(b)), ""], "size").count() == 2


def test_manifest(spark, folder):
    entries = spark.createDataFrame([("deep/with_title.md", "t2", None, "rfc", ["f"], {"k": "v"})], "path string, tenant_id string, bucket_id string, source_type string, features array<string>, metadata map<string,string>")
    found = {r.title: r for r in files.with_manifest(files.markdown(spark, folder), entries, folder, tenant_id="t1", bucket_id="b1").collect()}
    assert (found["The Title"].tenant_id, found["The Title"].bucket_id, found["The Title"].source_type, found["The Title"].metadata) == ("t2", "b1", "rfc", {"k": "v"})
    assert found["No Title"].tenant_id == "t1" and found["No Title"].source_type == "markdown"


def test_sinks(spark):
    rows = lambda *r: spark.createDataFrame(r, "id int, v string")
    assert sorted(map(tuple, sinks.upserted(rows((1, "a"), (2, "b")), rows((2, "c"), (3, "d")), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    failed = spark.createDataFrame([("d", "j", "parse", "x" * 3000)], "document_id string, job_id string, failed_stage string, error string")
    assert len(json.loads(sinks.failed_events(failed).first().value)["error"]) == 2000
    asked = spark.createDataFrame([("r", [("d1", "y" * 2000), ("d2", "z")])], "request_id string, sources array<struct<document_id:string,content:string>>")
    assert [(r["rank"], len(r.excerpt)) for r in sinks.request_log(asked)[1].orderBy("rank").collect()] == [(1, 1200), (2, 1)]
    calls = spark.createDataFrame([("ok", "q" * 600), ("error", "q")], "status string, result string")
    assert {r.status: r.preview and len(r.preview) for r in sinks.audit_rows(calls).collect()} == {"ok": 500, "error": None}
    named = rows((1, "A.txt"), (2, "a.txt"), (3, "b"))
    assert [r[0] for r in named.select("id", sinks.unique_names(named, "v", "id").alias("u")).orderBy("id").select("u").collect()] == ["A.txt", "a-2.txt", "b"]
    chunks = spark.createDataFrame([("t", "b", "p", "md", "T2", 1), ("t", "b", "p", "md", "T1", 0), ("t", "b", "q", "md", "Q", 0)], "tenant_id string, bucket_id string, source_path string, source_type string, title string, chunk_index int")
    assert [r.title for r in sinks.missing_assets(chunks, chunks.where("source_path = 'q'")).collect()] == ["T1"]


def test_consumer(spark, tmp_path):
    job = lambda kind, *ids: json.dumps({"event_type": kind, "event_id": "e", "job_ids": ids, "tenant_id": "t"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([job("indexing.requested", "1", "2"), "poison", job("other", "3")]))
    seen = []
    stream = events.parsed(spark.readStream.text(str(tmp_path / "in")), "indexing.requested")
    for _ in range(2):  # what was committed doesn't come again
        events.consume(stream, lambda df, _: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen) == ["1", "2"]


def test_jobs(spark):
    jobs = spark.createDataFrame([("1", "t", "pending"), ("2", "t", "completed"), ("3", "u", "pending"), ("4", " ", "pending")], "job_id string, tenant_id string, status string")
    wanted = spark.createDataFrame([("1", " t"), ("1", "t"), ("2", "t"), ("3", "t"), ("4", " ")], "job_id string, tenant_id string")
    assert [r.job_id for r in events.startable(jobs, wanted).collect()] == ["1"]
    done = events.finished(jobs.where("job_id in ('1', '3')"), F.when(F.col("job_id") == "3", "boom"), F.lit("nowhere"))
    assert {r.job_id: (r.status, r.failed_stage) for r in done.collect()} == {"1": ("completed", None), "3": ("failed", "index")}
    assert [(r.job_id, r.status) for r in events.retried(done, F.lit("9")).collect()] == [("9", "pending")]
    staged = spark.sql("select 1 as id, timestamp'2024-01-01' as expires_at union all select 2, timestamp'2024-01-03' union all select 3, null")
    assert sorted(r.id for r in events.unexpired(staged, F.lit("2024-01-02").cast("timestamp")).collect()) == [2, 3]


def test_malformed_json_is_a_row(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": ')
    (tmp_path / "good.json").write_text('{"title": "T"}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe\x00")
    got = {r["path"].rsplit("/", 1)[-1]: (r["source_type"], r["title"]) for r in files.json_files(spark, str(tmp_path)).collect()}
    assert got == {"bad.json": ("unreadable", "bad"), "good.json": ("json", "T"), "list.json": ("json", "List"), "bytes.json": ("unreadable", "bytes")}


def test_charts_with_their_sheets(spark, tmp_path):
    rel = lambda kind, target: f'<Relationships><Relationship Id="x1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    rows = "".join(f'<row r="{i}"{" hidden=" + chr(34) + "1" + chr(34) if i == 2 else ""}><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>b{i}</v></c></row>' for i in range(1, 40))
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rel("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rel("drawing", "../drawings/drawing1.xml"))
        z.writestr("xl/drawings/drawing1.xml", "<x/>")
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", rel("chart", "/xl/charts/chart1.xml"))
        z.writestr("xl/charts/chart1.xml", "<c><t>Sales</t><barChart>" + "".join(f"<f>S!A{i}</f>" for i in range(30)) + "</barChart><lineChart/></c>")
        z.writestr("xl/charts/chart2.xml", "<c>" + "".join(f"<t>l{i}</t>" for i in range(30)) + "</c>")
    one, two = sorted(files.xlsx_charts(spark, str(tmp_path)).collect(), key=lambda r: r["metadata"]["chart"])
    assert one["metadata"] == {"chart": "xl/charts/chart1.xml", "type": "barChart", "sheet": "S"} and one["title"] == "Sales"
    shown = [f"{i} | b{i}" for i in range(1, 40) if i != 2][:20]
    assert one["content"].split("\n") == ["barChart", "Sales", *(f"S!A{i}" for i in range(20)), *shown]
    assert two["metadata"] == {"chart": "xl/charts/chart2.xml", "type": "unknown"} and two["content"].split("\n")[1] == " ".join(f"l{i}" for i in range(20))
