"""Vectors by cell against a search through all; archives and old workbooks written and read back; résumés by pages."""

import hashlib
import struct
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import resumes
from millrace.operators import cells, retrieval
from millrace.sources import archives, files, xls

# --- vectors by cell


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    random = np.random.default_rng(3)
    middles = random.normal(size=(12, 8))
    rows = [(i, (middles[i % 12] + random.normal(size=8) * 0.05).tolist(), i % 5) for i in range(3000)]
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, rows[7][1], 2), (5003, rows[7][1], 2), (5004, [float("nan")] * 8, 3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(4)
    path = str(tmp_path_factory.mktemp("cells"))
    cells.build(df, path, id_col="id", vector_col="v", cells=12, sample_rows=500)
    return df, path, middles


def best(df, query, k, where=None):
    return [(r["id"], r["score"]) for r in retrieval.top_k(df, query, k, id_col="id", vector_col="v", where=where).collect()]


def test_cells_give_the_same_rows(spark, clustered):
    df, path, middles = clustered
    good = df.where("id <> 5004")
    random = np.random.default_rng(4)
    for query, k, where in [(middles[3].tolist(), 10, None), (random.normal(size=8).tolist(), 5, None), (middles[0].tolist(), 400, F.col("label") == 2), (middles[5].tolist(), 10, F.col("id") < 0)]:
        found = cells.search(spark, path, query, k, id_col="id", vector_col="v", where=(F.col("id") != 5004) if where is None else where & (F.col("id") != 5004))
        assert [(r["id"], r["score"]) for r in found.rows.collect()] == best(good, query, k, where)
    near = cells.search(spark, path, middles[3].tolist(), 10, id_col="id", vector_col="v")
    assert near.cells_read <= 4 and near.rows_read < 1500 < 3005  # clusters save most of the reading
    plan = near.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or f"{cells.CELL}" in plan.split("PartitionFilters")[1][:200]


def test_every_row_is_in_a_cell(spark, clustered):
    df, path, _ = clustered
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.count() == df.count() and {r["id"] for r in stored.where(F.col(cells.CELL) == cells.NONE).collect()} == {5000, 5001, 5004}
    small = df.where("id in (1, 5000, 5001)")
    all_ = f"{path}-small"
    cells.build(small, all_, id_col="id", vector_col="v", cells=4)
    assert [r["id"] for r in cells.search(spark, all_, [1.0] * 8, 5, id_col="id", vector_col="v").rows.collect()] == [1, 5000, 5001]
    cells.build(df.where("id in (5000, 5001)"), all_, id_col="id", vector_col="v")
    assert cells.search(spark, all_, [1.0] * 8, 5, id_col="id", vector_col="v").rows.count() == 2


# --- archives


def test_archives_hold_each_file_once(spark, tmp_path):
    rows = [(i, f"{'A' if i % 2 else 'a'}/{i % 7}.txt", bytes([i % 251]) * (i * 10)) for i in range(200)] + [(900, "none", None), (901, "é.bin", b"\0\xff")]
    df = spark.createDataFrame(rows, "path long, name string, content binary").repartition(5)
    archives.write_archives(df, str(tmp_path / "out"))
    files_ = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert all(n.startswith("part-") and n.endswith(".zip") for n in files_) and files_
    got = archives.read_archives(spark, str(tmp_path / "out")).collect()
    assert len({r["name"].lower() for r in got}) == len(got) == 202
    digest = lambda b: hashlib.sha256(bytes(b or b"")).hexdigest()
    assert sorted(digest(r["content"]) for r in got) == sorted(digest(r[2]) for r in rows)
    for path in (tmp_path / "out").iterdir():
        assert zipfile.ZipFile(path).testzip() is None
    archives.write_archives(df.where("path = 901"), str(tmp_path / "out"))  # added beside the others
    assert archives.read_archives(spark, str(tmp_path / "out")).count() == 203
    archives.write_archives(df.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists() or not list((tmp_path / "empty").iterdir())


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("path"), F.col("id").cast("string").alias("name"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"x")).alias("content")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        archives.write_archives(df, str(tmp_path / "out"))
    assert not list(Path(tmp_path / "out").rglob("*.zip"))


# --- old workbooks


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def shared(texts):
    """The table of texts: one that is continued has its width at the head of the next record again."""
    bodies = [struct.pack("<II", len(texts), len(texts))]
    for t in texts:
        if len(bodies[-1]) > 8200:
            bodies.append(b"")
        bodies[-1] += struct.pack("<HB", len(t), 1)
        left = utf16(t)
        while left:
            room = (8224 - len(bodies[-1])) // 2 * 2
            bodies[-1] += left[:room]
            left = left[room:]
            if left:
                bodies.append(b"\x01")
    return record(xls.SST, bodies[0]) + b"".join(record(xls.CONTINUE, x) for x in bodies[1:])


def utf16(text):
    return text.encode("utf-16-le")


def workbook(sheets, texts):
    """A BIFF8 stream: sheets are lists of (kind, body)."""
    listed = shared(texts)
    bodies = [record(xls.BOF, bytes(16)) + b"".join(record(k, b) for k, b in rows) + record(xls.EOF, b"") for _, rows in sheets]
    heads = lambda at: b"".join(record(xls.BOUNDSHEET, struct.pack("<IBBBB", a, 0, 0, len(n), 1) + utf16(n)) for (n, _), a in zip(sheets, at, strict=True))
    start = record(xls.BOF, bytes(16))
    before = len(start + heads([0] * len(sheets)) + listed + record(xls.EOF, b""))
    places = [before + sum(map(len, bodies[:i])) for i in range(len(sheets))]
    return start + heads(places) + listed + record(xls.EOF, b"") + b"".join(bodies)


def compound(stream, name="Workbook"):
    """A compound file with one stream, in small sectors where it is under 4096 bytes."""
    small = len(stream) < 4096
    pad = lambda b, n: b + bytes(-len(b) % n)
    held = pad(stream, 64) if small else stream
    sectors = [pad(held[i : i + 512], 512) for i in range(0, len(held), 512)]
    n = len(sectors)
    follow = [*range(1, n), 0xFFFFFFFE]
    fat_at = n + 2
    minis = struct.pack(f"<{len(held) // 64}I", *range(1, len(held) // 64), 0xFFFFFFFE) if small else b""
    entry = lambda title, kind, first, size: pad(utf16(title + "\0"), 64)[:64] + struct.pack("<HBB", 2 * len(title) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", first, size)
    root = entry("Root Entry", 5, 0 if small else 0xFFFFFFFE, len(held) if small else 0)
    directory = pad(root + entry(name, 2, 0, len(stream)), 512)
    fats = -(-(fat_at + 2 + n // 100) * 4 // 512)
    fat = follow + [0xFFFFFFFE, 0xFFFFFFFE] + [0xFFFFFFFD] * fats
    fat += [0xFFFFFFFF] * (fats * 128 - len(fat))
    head = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<I", fats) + struct.pack("<IIIIIII", n, 0, 4096, n + 1 if small else 0xFFFFFFFE, 1, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *(fat_at + i if i < fats else 0xFFFFFFFF for i in range(109)))
    return head + b"".join(sectors) + directory + (minis + b"\xff" * (512 - len(minis))) + struct.pack(f"<{len(fat)}I", *fat)


def cell(kind, row, column, body):
    return kind, struct.pack("<HHH", row, column, 0) + body


def sample(rows=3):
    texts = ["name", "n", "Анна", "x" * 9000, *(f"t{i}" for i in range(rows))]
    label = lambda r, c, i: cell(xls.LABELSST, r, c, struct.pack("<I", i))
    first = [label(0, 0, 0), label(0, 1, 1), label(1, 0, 2), cell(xls.NUMBER, 1, 1, struct.pack("<d", 7.0)), label(2, 0, 3), cell(xls.NUMBER, 2, 1, struct.pack("<d", 2.5))]
    first += [cell(xls.RK, 3, 1, struct.pack("<I", (12345 << 2) | 3)), (xls.MULRK, struct.pack("<HH", 4, 0) + struct.pack("<HIHI", 0, (5 << 2) | 2, 0, (0xFFFFFFFB << 2 & 0xFFFFFFFF) | 2) + struct.pack("<H", 1))]
    first += [cell(xls.FORMULA, 5, 0, b"\x00" + bytes(5) + b"\xff\xff" + bytes(8)), (xls.STRING, struct.pack("<HB", 3, 0) + b"abc"), cell(xls.FORMULA, 5, 1, struct.pack("<d", 1.25) + bytes(8)), cell(xls.BOOLERR, 6, 0, b"\x01\x00"), cell(xls.BOOLERR, 6, 1, b"\x07\x01"), cell(xls.LABEL, 7, 0, struct.pack("<HB", 2, 0) + b"ok")]
    second = [label(0, 0, 0), *(label(i + 1, 0, 4 + i) for i in range(rows))]
    return workbook([("Лист", first), ("more", second), ("none", [])], texts)


EXPECTED = [("Лист", 2, "name: Анна\nn: 7"), ("Лист", 3, f"name: {'x' * 9000}\nn: 2.5"), ("Лист", 4, "n: 123.45"), ("Лист", 5, "name: 5\nn: -5"), ("Лист", 6, "name: abc\nn: 1.25"), ("Лист", 7, "name: True\nn: #DIV/0!"), ("Лист", 8, "name: ok")]


@pytest.mark.parametrize("rows", [3, 5000])
def test_old_workbooks(spark, tmp_path, rows):
    (tmp_path / "a.xls").write_bytes(compound(sample(rows), "Workbook"))
    got = [(r["metadata"]["sheet"], int(r["metadata"]["excel_row_number"]), r["content"]) for r in files.xls_rows(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(EXPECTED + [("more", i + 2, f"name: t{i}") for i in range(rows)])


def test_small_streams_and_broken_files(spark, tmp_path):
    label = cell(xls.LABEL, 0, 0, struct.pack("<HB", 1, 0) + b"h"), cell(xls.LABEL, 1, 0, struct.pack("<HB", 1, 0) + b"v")
    whole = compound(workbook([("s", list(label))], []), "Book")
    (tmp_path / "small.xls").write_bytes(whole)
    locked = workbook([("s", list(label))], [])
    (tmp_path / "locked.xls").write_bytes(compound(locked[:20] + record(xls.FILEPASS, bytes(6)) + locked[20:]))
    circle = bytearray(whole)
    circle[-512 : -512 + 4] = struct.pack("<I", 0)
    for name, content in {"cut": whole[:700], "other": b"PK" + bytes(900), "circle": bytes(circle), "head": whole[:512]}.items():
        (tmp_path / f"{name}.xls").write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: (r["source_type"], r["content"]) for r in files.xls_rows(spark, str(tmp_path)).collect()}
    assert got["small.xls"] == ("xls", "h: v") and got["locked.xls"] == ("unreadable", "ValueError: an encrypted workbook")
    assert {k for k, (kind, _) in got.items() if kind == "unreadable"} == {f"{n}.xls" for n in ("cut", "other", "circle", "head", "locked")}
    documents = files.documents(spark, str(tmp_path))
    assert documents.where("source_type = 'xls'").count() == 1


# --- résumés

PAGES = ["Иван Петров\nинженер", "Май 2020 — Июнь 2022\nООО Ромашка\nДелал разное\nОсновные технологии:\nSpark, Java\n" + "работа " * 500, "продолжение\nЯнварь 2018 — Апрель 2020\nЛютик\nНавыки\nPython"]


def test_pages_become_sections_and_parts(spark, tmp_path):
    (tmp_path / "cv.pdf").write_bytes("\f".join(PAGES).encode())
    (tmp_path / "plain.pdf").write_bytes(b"one\f \fthree")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    docs = files.paged(spark, str(tmp_path), "*.pdf", lambda content: content.decode().split("\f"))
    got = {(r["path"].rsplit("/", 1)[-1], r["metadata"].get("section_kind"), r["metadata"].get("page_number")): r for r in docs.collect()}
    assert set(got) == {("cv.pdf", "profile", "1"), ("cv.pdf", "employment", "2"), ("cv.pdf", "employment", "3"), ("cv.pdf", "skills", "3"), ("plain.pdf", "page", "1"), ("plain.pdf", "page", "3"), ("bad.pdf", None, None)}
    assert got["bad.pdf", None, None]["source_type"] == "unreadable" and got["cv.pdf", "employment", "2"]["metadata"]["organization"] == "ООО Ромашка"
    named = docs.where("source_type = 'pdf'").withColumns({"tenant_id": F.lit("t"), "bucket_id": F.lit("b")})
    chunks = files.ingested(named).where(F.col("path").endswith("cv.pdf")).collect()
    long = [r["content"] for r in chunks if r["metadata"]["page_number"] == "2"]
    assert len(long) == 2 and all("Организация: ООО Ромашка" in c and "Spark, Java" in c and len(c) <= 2200 for c in long)


def test_ten_thousand_pieces_take_linear_time(spark):
    job = "Май 2020 — Июнь 2022\nФирма\nработа"
    took = []
    for n in (1_250, 10_000):
        df = spark.createDataFrame([([f"{job} {i}" for i in range(n)],)], "pages array<string>")
        began = time.perf_counter()
        (r,) = df.select(resumes.sections(F.col("pages")).alias("s")).collect()
        took.append(time.perf_counter() - began)
        assert [s["page"] for s in r["s"]] == list(range(1, n + 1)) and r["s"][n - 1]["content"] == f"{job} {n - 1}"
    assert took[1] < 20 * max(took[0], 0.5), took
