"""Documents from files. Each reader gives the columns of DOCUMENT; a file is read by one task and never by the driver."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import resumes, text
from ..operators import numbering, retrieval
from . import tables, xls

DOCUMENT = ["path", "source_type", "title", "content", "features", "metadata"]
DOCUMENT_SCHEMA = "path string, source_type string, title string, content string, features array<string>, metadata map<string,string>"
#: A folder, or the paths of files.
Where = str | list[str]
SHEET_ROW = "sheet string, at int, names array<string>, cells array<string>"
METHODS = ["get", "put", "post", "delete", "patch", "head", "options", "trace"]


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _document(df: DataFrame, kind: str, title: Column, content: Column, metadata: Column | None = None, features: Column | None = None) -> DataFrame:
    """Rows with blank content go. A file that couldn't be read is a row of type `unreadable` with the error as content."""
    none, bare = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    if "error" in df.columns:
        failed, kind_ = F.col("error").isNotNull(), F.when(F.col("error").isNotNull(), "unreadable").otherwise(kind)
        title, content = F.when(failed, _stem(F.col("path"))).otherwise(title), F.when(failed, F.col("error")).otherwise(content)
        metadata, features = (F.when(failed, bare).otherwise(metadata) if metadata is not None else None), (F.when(failed, none).otherwise(features) if features is not None else None)
    else:
        kind_ = F.lit(kind)
    out = df.select("path", kind_.alias("source_type"), title.alias("title"), content.alias("content"), (none if features is None else features).alias("features"), (bare if metadata is None else metadata).alias("metadata"))
    return out.where(text.strip(F.col("content")) != "")


def _texts(spark: SparkSession, folder: Where, glob: str) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _parsed(spark: SparkSession, folder: Where, glob: str, parse: Callable[[bytes], Iterable[tuple]], fields: str) -> DataFrame:
    """Rows of `parse` for each binary file that isn't empty; a file that can't be read, whatever the reason, is one row whose `error` says why."""
    names = [f.split()[0] for f in fields.split(", ")]

    def table(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["path", *names, "error"], dtype=object)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, size = [], 0  # of small files many make one table
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [(path, *r, None) for r in parse(content)]
                except Exception as e:  # noqa: BLE001 - what a broken file raises isn't known; the row tells it
                    found = [(path, *(None for _ in names), f"{type(e).__name__}: {e}")]
                made, size = made + found, size + len(content)
                if size > 1_000_000 or len(made) > 500:
                    yield table(made)
                    made, size = [], 0
            yield table(made)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(rows, f"path string, {fields}, error string")


def markdown(spark: SparkSession, folder: Where) -> DataFrame:
    """The title is the first heading of the first level, else the file's name."""
    files = _texts(spark, folder, "*.md")
    return _document(files, "markdown", text.markdown_title(F.col("value"), _stem(F.col("path"))), F.col("value"))


def plain(spark: SparkSession, folder: Where) -> DataFrame:
    return _document(_texts(spark, folder, "*.txt"), "text", text.markdown_title(F.lit(""), _stem(F.col("path"))), F.col("value"))


def _pretty(content: bytes) -> Iterator[tuple]:
    found = json.loads(content)
    named = [str(found[k]) for k in ("title", "name", "id") if isinstance(found, dict) and found.get(k)]
    yield named[0] if named else None, json.dumps(found, ensure_ascii=False, indent=2, sort_keys=True)


def json_files(spark: SparkSession, folder: Where, manifest: str = "ingestion_manifest.json") -> DataFrame:
    """Content is the dump with sorted keys; a malformed file is a row of type unreadable. The manifest isn't a document."""
    files = _parsed(spark, folder, "*.json", _pretty, "named string, body string").where(~F.col("path").endswith(f"/{manifest}"))
    return _document(files, "json", F.coalesce("named", text.markdown_title(F.lit(""), _stem(F.col("path")))), F.col("body"))


def csv_rows(spark: SparkSession, folder: Where, *, title_col: str | None = None, features_col: str | None = "feature") -> DataFrame:
    """One document for each row, by the header of its own file. Nulls are empty strings; of equal names the last counts.

    The title is the named column's, or the first's."""
    rows = tables.read_csv(spark, folder).select("path", "names", F.slice("cells", 1, F.size("names")).alias("cells"))
    last = F.transform_keys(F.map_from_entries(F.transform(F.array_distinct("names"), lambda n: F.struct(n, F.element_at("cells", F.size("names") + 1 - F.array_position(F.reverse("names"), n).cast("int"))))), lambda k, v: k)
    rows = rows.withColumn("row", last)
    cell = lambda name: F.try_element_at("row", F.lit(name))
    title = F.coalesce(cell(title_col), F.col("cells")[0]) if title_col else F.col("cells")[0]
    lines = F.filter(F.transform("names", lambda n: F.when(text.strip(F.element_at("row", n)) != "", F.concat(n, F.lit(": "), F.element_at("row", n)))), lambda x: x.isNotNull())
    listed = F.filter(F.transform(F.split(F.coalesce(cell(features_col), F.lit("")), ","), text.strip), lambda x: x != "") if features_col else None
    return _document(rows, "csv", title, F.array_join(F.array_distinct(lines), "\n"), F.col("row"), listed)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of one a line; malformed lines raise. Files split at line ends, so large ones are read by many tasks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str, schema: str, *, across: bool = False) -> DataFrame:
    """path, line (from 1 in its file, or `across` all files in the order of their paths), and the object of each line that
    isn't blank; malformed lines raise when their fields are read.

    Files split at line ends; the lines are numbered by ranges of (file, split, place in it), so a large file is many tasks'.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_in_split"), F.col("value").alias("raw"))
    placed = numbering.numbered(lines, ["path", "_split", "_in_split"], "at") if across else numbering.numbered(lines, ["_split", "_in_split"], "at", group=["path"])
    return placed.where(text.strip(F.col("raw")) != "").select("path", (F.col("at") + 1).cast("int").alias("line"), F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("row")).select("path", "line", "row.*")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the raw bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def _endpoints(content: bytes) -> Iterator[tuple]:
    try:
        found = json.loads(content)
    except ValueError:
        import yaml  # where it isn't installed only JSON specifications can be read

        found = yaml.safe_load(content)
    for route, methods in (found.get("paths") or {}).items():
        for method in METHODS:
            if method in methods:
                about = methods[method] or {}
                yield route, method.upper(), about.get("summary"), about.get("description"), [str(t) for t in about.get("tags") or []]


def openapi(spark: SparkSession, folder: Where, glob: str = "*openapi*.{json,yaml,yml}") -> DataFrame:
    """One document for each path and method."""
    rows = _parsed(spark, folder, glob, _endpoints, "route string, method string, summary string, description string, tags array<string>")
    title = F.concat_ws(" ", "method", "route")
    return _document(rows, "openapi", title, F.concat_ws("\n", title, "summary", "description"), F.create_map(F.lit("route"), F.col("route"), F.lit("method"), F.col("method")), F.col("tags"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _inner(node: ElementTree.Element) -> str:
    return "".join(n.text or "" for n in node.iter() if _local(n.tag) == "t")


def _blocks(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    at = table = 0
    for block in body:
        if _local(block.tag) == "p" and (found := _inner(block).strip()):
            yield "paragraph", at, found
            at += 1
        elif _local(block.tag) == "tbl":
            for k, row in enumerate(r for r in block if _local(r.tag) == "tr"):
                yield f"table_{table}", k, " | ".join(_inner(c).strip() for c in row if _local(c.tag) == "tc")
            table += 1


def docx(spark: SparkSession, folder: Where) -> DataFrame:
    """Paragraphs with the texts before and after them, and rows of tables."""
    rows = _parsed(spark, folder, "*.docx", _blocks, "kind string, place int, content string")
    order = Window.partitionBy("path", "kind").orderBy("place")
    around = rows.withColumns({"before": F.lag("content").over(order), "after": F.lead("content").over(order)})
    metadata = F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("place"), F.col("place").cast("string"), F.lit("previous"), F.col("before"), F.lit("next"), F.col("after")), lambda k, v: v.isNotNull())
    return _document(around, "docx", text.markdown_title(F.lit(""), _stem(F.col("path"))), F.col("content"), metadata)


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for node in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(node.tag) == "sheet":
            target = links[next(v for k, v in node.attrib.items() if _local(k) == "id")]
            yield node.get("name", ""), target.removeprefix("/") if target.startswith("/") else f"xl/{target}"


def _shared(z: zipfile.ZipFile) -> list[str]:
    return [_inner(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    value = next((n.text or "" for n in cell if _local(n.tag) == "v"), _inner(cell))
    return shared[int(value)] if cell.get("t") == "s" else value


def _sheet_rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared(z)
        for name, file in _sheets(z):
            header: dict[str, str] = {}
            for row in (n for n in ElementTree.fromstring(z.read(file)).iter() if _local(n.tag) == "row"):
                cells = {}
                for cell in row:
                    cells[re.sub(r"\d", "", cell.get("r", ""))] = _cell(cell, shared)
                if header:
                    yield name, int(row.get("r", 0)), [header.get(c, c) for c in cells], list(cells.values())
                else:
                    header = cells


def _old_sheet_rows(content: bytes) -> Iterator[tuple]:
    for name, rows in xls.sheets(content):
        header: dict[int, str] = {}
        for at in sorted(rows):
            if header:
                yield name, at + 1, [header.get(c, str(c + 1)) for c in sorted(rows[at])], [rows[at][c] for c in sorted(rows[at])]
            else:
                header = rows[at]


def xls_rows(spark: SparkSession, folder: Where) -> DataFrame:
    """The same of old workbooks, as `xlsx_rows`."""
    return _row_documents(_parsed(spark, folder, "*.xls", _old_sheet_rows, SHEET_ROW), "xls")


def xlsx_rows(spark: SparkSession, folder: Where) -> DataFrame:
    """One document for each row under a sheet's header; the row's number in the sheet is in the metadata."""
    return _row_documents(_parsed(spark, folder, "*.xlsx", _sheet_rows, SHEET_ROW), "xlsx")


def _row_documents(rows: DataFrame, kind: str) -> DataFrame:
    lines = F.filter(F.zip_with("names", "cells", lambda n, c: F.when(text.strip(c) != "", F.concat(n, F.lit(": "), c))), lambda x: x.isNotNull())
    title = F.concat(_stem(F.col("path")), F.lit(" / "), F.col("sheet"))
    return _document(rows, kind, title, F.array_join(lines, "\n"), F.create_map(F.lit("sheet"), F.col("sheet"), F.lit("excel_row_number"), F.col("at").cast("string")))


def _linked(z: zipfile.ZipFile, file: str, kind: str) -> list[str]:
    """The files of a kind that a file of the workbook refers to."""
    folder, name = file.rsplit("/", 1)
    links = f"{folder}/_rels/{name}.rels"
    if links not in z.namelist():
        return []
    found = [r.get("Target", "") for r in ElementTree.fromstring(z.read(links)) if r.get("Type", "").endswith(f"/{kind}")]
    return [posixpath.normpath(t[1:] if t.startswith("/") else f"{folder}/{t}") for t in found]


def _visible(z: zipfile.ZipFile, file: str, shared: list[str], most: int) -> list[str]:
    """The first rows of a sheet that aren't hidden, their cells joined."""
    rows = (n for n in ElementTree.fromstring(z.read(file)).iter() if _local(n.tag) == "row" and n.get("hidden") not in ("1", "true"))
    return [" | ".join(_cell(c, shared) for c in row) for row in islice(rows, most)]


def _charts(content: bytes, most: int = 20) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared(z)
        on = {chart: (name, file) for name, file in (_sheets(z) if "xl/workbook.xml" in z.namelist() else ()) for drawing in _linked(z, file, "drawing") for chart in _linked(z, drawing, "chart")}
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/charts/chart\d*\.xml", n)):
            nodes = list(ElementTree.fromstring(z.read(name)).iter())
            kinds = list(dict.fromkeys(_local(n.tag) for n in nodes if _local(n.tag).endswith("Chart")))
            labels = [n.text.strip() for n in nodes if _local(n.tag) == "t" and (n.text or "").strip()]
            refs = [n.text for n in nodes if _local(n.tag) == "f" and n.text]
            sheet, file = on.get(name, (None, None))
            yield name, sheet, kinds[0] if kinds else "unknown", labels[:most], refs[:most], _visible(z, file, shared, most) if file else []


def xlsx_charts(spark: SparkSession, folder: Where) -> DataFrame:
    """One document for each chart: its type, first 20 labels and references, and the first 20 rows of its sheet that aren't hidden;
    of a chart that no sheet refers to what its own file says."""
    rows = _parsed(spark, folder, "*.xlsx", _charts, "chart string, sheet string, kind string, labels array<string>, refs array<string>, shown array<string>")
    title = F.coalesce(F.try_element_at("labels", F.lit(1)), _stem(F.col("path")))
    lines = F.filter(F.concat(F.array("kind"), F.array(F.array_join("labels", " ")), "refs", "shown"), lambda x: x != "")
    facts = F.create_map(F.lit("chart"), F.col("chart"), F.lit("type"), F.col("kind"), F.lit("sheet"), F.col("sheet"))
    return _document(rows, "xlsx_chart", title, F.array_join(lines, "\n"), F.map_filter(facts, lambda k, v: v.isNotNull()))


def recognised(spark: SparkSession, folder: str, glob: str, reader: Callable[[bytes], Iterable[str]], kind: str) -> DataFrame:
    """One document for each text that `reader` (pages of a PDF, recognition of an image) finds in a file."""
    rows = _parsed(spark, folder, glob, lambda content: enumerate(reader(content)), "part int, found string")
    return _document(rows, kind, text.markdown_title(F.lit(""), _stem(F.col("path"))), F.col("found"), F.create_map(F.lit("part"), F.col("part").cast("string")))


def paged(spark: SparkSession, folder: Where, glob: str, reader: Callable[[bytes], Iterable[str]], kind: str = "pdf") -> DataFrame:
    """One document for each page with text that `reader` finds in a file, or for each section where the pages are a résumé's;
    with section_kind (page for a page), organization and page_number in the metadata."""
    rows = _parsed(spark, folder, glob, lambda content: enumerate(reader(content)), "part int, found string")
    read = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "found"))))  # the pages of one file
    files = rows.groupBy("path").agg(F.max("error").alias("error"), F.transform(read, lambda p: p["found"]).alias("pages"))
    page = F.transform("pages", lambda p, i: F.struct(F.lit("page").alias("kind"), F.coalesce(p, F.lit("")).alias("content"), F.lit("").alias("organization"), (i + 1).alias("page")))
    cut = files.select("path", "error", F.explode_outer(F.coalesce(resumes.sections(F.col("pages")), page)).alias("s"))
    facts = F.create_map(F.lit("section_kind"), F.col("s.kind"), F.lit("organization"), F.col("s.organization"), F.lit("page_number"), F.col("s.page").cast("string"))
    stem = text.markdown_title(F.lit(""), _stem(F.col("path")))
    title = F.when(F.col("s.kind") == "page", stem).otherwise(F.concat_ws(" - ", stem, F.coalesce(F.nullif(F.col("s.organization"), F.lit("")), "s.kind")))
    return _document(cut, kind, title, F.col("s.content"), F.map_filter(facts, lambda k, v: v.isNotNull() & (v != "")))


def paragraph_windows(docs: DataFrame, *, size: int = 8, step: int = 6) -> DataFrame:
    """Overlapping windows over the paragraphs of `docx`, with their first and last paragraph; documents like the others."""
    paragraphs = docs.where(F.try_element_at("metadata", F.lit("kind")) == "paragraph").select("path", F.element_at("metadata", "place").cast("int").alias("place"), "content")
    cut = retrieval.windows(paragraphs, "path", "place", size=size, step=step)
    first, last = F.col("rows")[0]["place"], F.element_at("rows", -1)["place"]
    lines = F.transform("rows", lambda r: F.concat(F.lit("Paragraph "), (r["place"] + 1).cast("string"), F.lit(": "), r["content"]))
    reach = F.concat((first + 1).cast("string"), F.lit("-"), (last + 1).cast("string"))
    metadata = F.create_map(F.lit("kind"), F.lit("paragraph_window"), F.lit("window"), F.col("window_no").cast("string"), F.lit("first"), first.cast("string"), F.lit("last"), last.cast("string"))
    return _document(cut, "docx", F.concat(_stem(F.col("path")), F.lit(" - paragraphs "), reach), F.concat_ws("\n", F.concat(F.lit("Paragraph range: "), reach), F.array_join(lines, "\n")), metadata)


def documents(spark: SparkSession, where: Where, readers: Mapping[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """All documents of a folder, or of files, by all readers in their order."""
    readers = readers or {"markdown": markdown, "text": plain, "json": json_files, "csv": csv_rows, "openapi": openapi, "docx": docx, "xlsx": xlsx_rows, "xls": xls_rows, "charts": xlsx_charts}
    docs = reduce(DataFrame.unionByName, (read(spark, where) for read in readers.values()))
    return docs.withColumn("path", tables.uri(F.col("path")))


def corpus(spark: SparkSession, folder: str, readers: Mapping[str, Callable[[SparkSession, str], DataFrame]] | None = None, manifest: DataFrame | None = None, *, tenant_id: str, bucket_id: str) -> DataFrame:
    """All documents of a folder by all readers in their order, the manifest's entries over them; see `with_manifest`."""
    docs = documents(spark, folder, readers)
    if manifest is None:
        manifest = spark.createDataFrame([], "path string, tenant_id string, bucket_id string, source_type string, features array<string>, metadata map<string,string>")
    return with_manifest(docs, manifest, folder, tenant_id=tenant_id, bucket_id=bucket_id)


def ingested(docs: DataFrame, *, size: int = 1800, overlap: int = 200) -> DataFrame:
    """A corpus as chunks with ids, ready for a table of vectors: chunk_id, point_id, and the document's columns.

    Sections of a résumé are cut in parts of their own, which repeat a job's employer and technologies."""
    kind = F.try_element_at("metadata", F.lit("section_kind"))
    parts = F.transform(resumes.parts(F.col("content"), kind, F.coalesce(F.try_element_at("metadata", F.lit("organization")), F.lit(""))), lambda c, i: F.struct(i.alias("chunk_index"), c.alias("chunk")))
    cut = docs.withColumn("_c", F.explode(F.when(kind != "page", parts).otherwise(text.chunks(F.col("content"), size, overlap))))
    chunk_id = F.concat_ws(":", "path", F.lit("chunk"), F.col("_c.chunk_index").cast("string"))
    return cut.select(chunk_id.alias("chunk_id"), text.uuid5(F.concat_ws(":", "tenant_id", "bucket_id", chunk_id)).alias("point_id"), "path", "tenant_id", "bucket_id", "source_type", "title", F.col("_c.chunk").alias("content"), "features", "metadata")


def with_manifest(docs: DataFrame, manifest: DataFrame, root: str, *, tenant_id: str, bucket_id: str) -> DataFrame:
    """Tenant, bucket, type and features of a path's manifest entry win; its metadata is merged over the document's.

    `manifest` has path (below `root`), tenant_id, bucket_id, source_type, features, metadata; of repeated paths one row stays.
    """
    own = manifest.dropDuplicates(["path"]).select(F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in ("tenant_id", "bucket_id", "source_type", "features", "metadata")))
    below = F.regexp_replace(F.col("path"), r"^(file:)?/*", "/").substr(F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    joined = docs.join(own, below == F.col("_path"), "left")
    none = F.create_map().cast("map<string,string>")
    metadata = F.map_from_entries(F.concat(F.map_entries(F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("_metadata", k), F.lit(False)))), F.map_entries(F.coalesce("_metadata", none))))
    return joined.select(
        "path", F.coalesce("_source_type", "source_type").alias("source_type"), "title", "content", F.coalesce("_features", "features").alias("features"), metadata.alias("metadata"),
        F.coalesce("_tenant_id", F.lit(tenant_id)).alias("tenant_id"), F.coalesce("_bucket_id", F.lit(bucket_id)).alias("bucket_id"),
    )
