"""Functions and operators that SQL can't hold, against plain Python on small tables."""

import unicodedata
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.functions import resumes, rules, text
from millrace.operators import access, evaluation, memory, metrics, retrieval, scope
from millrace.plans import catalogue
from millrace.sources import files, sinks
from millrace.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = list(values)
    df = spark.range(1).select(*(F.lit(v).alias(n) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(n) for n, v in values.items()))
    return df.select(*names).select(column).first()[0]


def test_uuid5(spark):
    rows = catalogue.QUERIES["uuid5_ids"](spark, SF).collect()
    assert rows and all(r["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"doc:{r['doc_id']}")) for r in rows)


def test_prompt_memory_budget(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], 0 if not r["text"] else max(1, len(r["text"]) // 4)))
    want = {}
    for k, parts in said.items():
        used = n = 0
        for _, cost in sorted(parts):
            if used + cost <= 350:
                used, n = used + cost, n + 1
        want[k] = (n, used)
    assert {r["conv_id"]: (r["n_kept"], r["used"]) for r in catalogue.QUERIES["prompt_memory_budget"](spark, SF).collect()} == want


def test_prompt_memory(spark):
    history = spark.createDataFrame([(1, p, "x" * 400) for p in (1, 2, 3)] + [(3, 1, "short")], "session_id int, place int, content string")
    summaries = spark.createDataFrame([(1, "s" * 40, ["a", "b", "c"]), (2, "", None)], "session_id int, summary string, goals array<string>")
    got = {r["session_id"]: (r["labels"], r["used"]) for r in memory.prompt_memory(history, summaries, budget=220).collect()}
    assert got == {1: (["summary", "goals", "message 3", "message 2"], 10 + 1 + 100 + 100), 2: ([], 0), 3: (["message 1"], 1)}


def test_nfc_and_first_wins(spark):
    rows = [(1, "é"), (2, "é"), (3, None), (4, None), (5, "x")]
    d = spark.createDataFrame(rows, "id int, t string")
    assert [r[0] for r in d.select(rules.nfc("t")).collect()] == [None if t is None else unicodedata.normalize("NFC", t) for _, t in rows]
    got = {r["id"]: r["duplicate_of"] for r in retrieval.first_wins(d, "id", rules.nfc("t")).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None}


NUMBERS = {
    "-007.50": "7.5", "€ 1 250": "1250", "1 250 000": "1250000", "1,250,000.00": "1250000", "1.250.000,50": "1250000.5", "1,250": "1250", "12,50": "12.5", "1234,567": "1234.567", "0,000": "0", "0.5": "0.5", ".500": "0.5", "0012": "12",
    "1,23,45": "123.45", "1.234.56": "1234.56", "none": None, "": None, "-": None, "+3,0": "3", "1\u00a0000,10 RUB": "1000.1", "000": "0", "12.": "12", "5%": "5", "1,250,0": "1250", None: None,
}


def test_numbers_have_one_form(spark):
    rows = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, t string")
    got = dict(rows.select("t", text.numeric_normal_form(F.col("t"))).collect())
    assert got == NUMBERS
    plan = rows.select(text.numeric_normal_form(F.col("t")).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(t") <= 2  # the cleaned text is bound once
    for said, there in (("12.50 and 3,0", True), ("12,5", False), ("v12.5 3", False), ("3 of 1 012,50", False), ("(12,50) 3.", True)):
        assert one(spark, rules.has_numbers(F.col("t"), ["12,5", "3"]), t=said) is there, said


def test_lexicon_keys_are_folded_and_composed(spark):
    import unicodedata as u

    rows = [(1, "  STRASSE\t  a "), (2, "Straße A"), (3, "Cafe\u0301"), (4, "CAFÉ"), (5, None), (6, ""), (7, "ΣΑΣ ς"), (8, "plain\u00a0 text")]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", text.lexicon_key(F.col("t"))).collect())
    assert got == {i: None if t is None else " ".join(u.normalize("NFC", t).casefold().split()) for i, t in rows}
    hits = one(spark, rules.must_not_hits(F.col("t"), ["Cafe\u0301", " ", "ß", "x"]), t="am CAFÉ")
    assert hits == ["Cafe\u0301"]


@pytest.mark.parametrize("path", ["a.b/c", "x/y.tar.gz", "user_feedback/q.csv", "release_notes/incident.txt"])
def test_source_types(spark, path):
    from pathlib import PurePosixPath

    want = PurePosixPath(path).suffix.lstrip(".") or "text"
    want = "support_ticket" if "user_feedback" in path else "incident_note" if "incident" in path else want
    assert one(spark, rules.source_type_of(F.col("p")), p=path) == want


def test_file_names(spark):
    said = 'См. файл Отчет за май.xlsx, "My plan.PDF", my PLAN.pdf, 12 план работ.docx; a-b.csv; A-B.CSV'
    got = one(spark, rules.file_names(F.col("m")), m=said)
    assert got[0] == "My plan.PDF" and "Отчет за май.xlsx" in got and "12 план работ.docx" in got and [x for x in got if x.lower() == "a-b.csv"] == ["a-b.csv"]


def test_contexts_and_topics(spark):
    for said, word, around in (("no Webhook here, a webhook there", "webhook", 5), ("webhookwebhook", "webhook", 3), ("ab" * 200 + "c++" + "d" * 300, "C++", 100), ("x" * 100 + "c++" + "y" * 100, "c++", 100), ("nothing", "webhook", 5), ("aaaa", "aa", 1), ("line\none webhook\ntwo", "webhook", 10)):
        low, w, want, at = said.lower(), word.lower(), [], 0
        while (at := low.find(w, at)) >= 0:
            want.append(low[max(0, at - around) : at + len(w) + around])
            at += len(w)
        assert one(spark, rules.contexts(F.col("t"), word, around), t=said) == want, said
    found = spark.range(1).select(rules.allowed_topics(F.array(F.lit("TASKS"), F.lit("x"), F.lit("tasks")), ["tasks"]).alias("f")).first()["f"]
    assert (found["kept"], found["discarded"]) == (["tasks"], ["x"])


def test_access(spark):
    docs = spark.createDataFrame([(1, "t", "u1", "private", []), (2, "t", "x", "tenant", []), (3, "t", "x", "private", ["r"]), (4, "t", "x", "private", []), (5, "o", "u1", "tenant", []), (6, "t", "x", "private", [])], "document_id int, tenant_id string, owner_id string, visibility string, allowed_roles array<string>")
    entries = spark.createDataFrame([(4, "role", "r", "read"), (6, "user", "u1", "write"), (2, "user", "u2", "admin")], "document_id int, subject_type string, subject_id string, permission string")
    ids = lambda f, roles: {r["document_id"] for r in f(docs, entries, tenant="t", user="u1", roles=roles).collect()}
    assert ids(access.readable, ["r"]) == {1, 2, 3, 4, 6} and ids(access.readable, ["q"]) == {1, 2, 6}
    assert ids(access.manageable, ["r"]) == {1, 6} and ids(access.manageable, ["admin"]) == {1, 2, 3, 4, 6}
    pairs = [("a", " a ", True), ("", "", False), (None, "a", False), ("a", "b", False)]
    d = spark.createDataFrame(pairs, "l string, r string, want boolean")
    assert d.where(access.tenant_matches(F.col("l"), F.col("r")) != F.col("want")).isEmpty()
    assert one(spark, access.confined(F.col("r"), F.col("s"), F.col("c")), r=["z"], s=["a"], c=["b"]) == ["a"]


def test_filters(spark):
    d = spark.createDataFrame([(1, "t", ["a"], "x", 0.3), (2, "t", ["b"], "y", None), (3, "o", ["a", "b"], "x", 0.9)], "id int, tenant string, features array<string>, path string, score double")
    ids = lambda **k: {r["id"] for r in d.where(retrieval.payload_filter(**k)).collect()}
    assert ids(overlap={"features": ["a", "q"]}) == {1, 3} and ids(either={"id": [2], "path": ["x"]}) == {1, 2, 3} and ids(equal={"tenant": "t"}, either={"id": [2], "path": []}) == {2}
    assert ids() == {1, 2, 3}
    assert {r["id"] for r in retrieval.above_threshold(d, 0.3).collect()} == {1, 3}
    assert (retrieval.lowered_threshold(None), retrieval.lowered_threshold(0.3), retrieval.lowered_threshold(0.9)) == (0.45, 0.3, 0.45)
    assert {r["path"]: r["s"] for r in d.groupBy("path").agg(metrics.run_status(F.col("score") > 0.5).alias("s")).collect()} == {"x": "failed", "y": "completed"}


def test_gates_raise(spark):
    rows = spark.createDataFrame([(1, "h1", 0, 0.5)], "id int, arm string, hits int, m double")
    with pytest.raises(Exception, match="both arms"):
        evaluation.accepted(rows, arm="arm", hits="hits", metrics=["m"]).collect()
    with pytest.raises(ValueError, match="holdout"):
        evaluation.refuse(rows, "rows of the holdout")
    evaluation.refuse(rows.limit(0), "none")
    with pytest.raises(ValueError):
        sinks.write_jsonl(rows, "/x/holdout/part", "/x/holdout")


def test_limits_and_policies(spark):
    broken = one(spark, scope.broken_limits(F.col("m"), F.lit(0), {"tags": F.col("t")}, chars=3, most_k=5, items=2, item_chars=4), m="long message", t=["a", "toolong"])
    assert broken == ["message", "top_k", "tags"]
    rows = spark.createDataFrame([("t", "up 5%\nfine", True), ("t", "up 5%\nfine", False)], "title string, content string, p boolean")
    assert {r["content"] for r in scope.under_policy(rows, F.col("p"), ["nps"], "none").collect()} == {"fine", "up 5%\nfine"}
    assert one(spark, scope.is_indexed_image(F.col("s"), F.col("k")), s="indexed", k="PNG")


def test_sinks(spark, tmp_path):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    incoming = spark.createDataFrame([(2, "c", 3), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in sinks.upserted(current, incoming, ["id"], ["at"]).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    jobs = spark.createDataFrame([("r", "t", "j2"), ("r", "t", "j1"), ("r", "t", "j2")], "request_id string, tenant_id string, job_id string")
    event = sinks.requested_events(jobs).first()
    assert event["key"] == "j1" and '"job_ids":["j1","j2"]' in event["value"]
    sinks.write_jsonl(current, f"{tmp_path}/out", f"{tmp_path}/holdout")
    read = files.numbered_lines(spark, f"{tmp_path}/out", "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in read.collect()} == {(1, "a"), (2, "b")} and read.agg(F.min("line")).first()[0] == 1
    remote = spark.createDataFrame([("7", "x", 9)], "external_id string, v string, at int")
    ours = spark.createDataFrame([], "id string, tenant_id string, v string, at int")
    row = sinks.synced(ours, remote, "t", "orders").first()
    assert row["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "t:orders:7")) and sinks.synced(sinks.synced(ours, remote, "t", "orders"), remote, "t", "orders").count() == 1
    got = spark.createDataFrame([("p/a.txt", bytearray(b"hi"))], "path string, content binary")
    buckets = spark.createDataFrame([("b1", "Docs", "t")], "bucket_id string, name string, tenant_id string")
    docs, new = sinks.staged(got, buckets, bucket="Docs", tenant_id="t", now=F.lit("2024-01-01").cast("timestamp"))
    assert docs.first()["bucket_id"] == "b1" and new.isEmpty()
    docs, new = sinks.staged(got, buckets, bucket="Other", tenant_id="t", now=F.lit("2024-01-01").cast("timestamp"))
    assert docs.first()["bucket_id"] == new.first()["bucket_id"] and docs.first()["status"] == "pending"
    with pytest.raises(Exception, match="empty file"):
        sinks.staged(got.withColumn("content", F.lit(b"")), buckets, bucket="Docs", tenant_id="t", now=F.current_timestamp())[0].collect()


def test_jobs(spark):
    jobs = spark.createDataFrame([("j1", "t", "pending", "d1"), ("j2", "t", "completed", "d2"), ("j3", "t", "failed", "d3"), ("j4", "o", "pending", "d4")], "job_id string, tenant_id string, status string, document_id string")
    wanted = spark.createDataFrame([(j, " t ") for j in ("j1", "j2", "j3", "j4", "j1")], "job_id string, tenant_id string")
    begun = {r["job_id"]: r["status"] for r in events.started(jobs, wanted, F.current_timestamp()).collect()}
    assert begun == {"j1": "running", "j3": "running"}
    documents = spark.createDataFrame([("d1", "indexing"), ("d3", "failed")], "document_id string, status string")
    assert {(r["document_id"], r["status"]) for r in events.reopened(documents, jobs).collect()} == {("d1", "indexing"), ("d3", "indexing")}


def test_chunks_strip_a_text_once(spark):
    long = " " + "word " * 200_000
    made = spark.createDataFrame([(long,)], "t string").select(F.explode(text.chunks(F.col("t"))).alias("c")).collect()
    body = long.strip()
    want = [c for c in (body[s : s + 1800].strip() for s in range(0, max(len(body) - 200, 1), 1600)) if c]
    assert [r["c"]["chunk"] for r in made] == want


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "a.md").write_text("# Title\nBody")
    (tmp_path / "b.txt").write_text("plain")
    rows = files.corpus(spark, str(tmp_path), {"markdown": files.markdown, "text": files.plain, "docx": files.docx}, tenant_id="t", bucket_id="b").collect()
    assert {(r["source_type"], r["tenant_id"]) for r in rows} == {("markdown", "t"), ("text", "t"), ("unreadable", "t")}
    docs = files.corpus(spark, str(tmp_path), {"markdown": files.markdown}, tenant_id="t", bucket_id="b")
    assert files.ingested(docs).first()["chunk_id"].endswith(":chunk:0")


RESUME = ["Иван\u00a0Петров\nинженер", "Май 2020 — Июнь 2022\n2 года 1 месяц\nООО Ромашка\nДелал разное\nОсновные технологии:\nSpark, Java", "продолжение\nЯнварь 2018 — Апрель 2020\nЛютик\nНавыки\nPython\nОбо мне добрый"]


def test_resume_sections(spark):
    d = spark.createDataFrame([(1, RESUME), (2, ["Май 2020 — Июнь 2022", "x"]), (3, [])], "id int, pages array<string>")
    got = {r["id"]: r["s"] for r in d.select("id", resumes.sections(F.col("pages")).alias("s")).collect()}
    assert got[2] is None and got[3] is None
    assert [(s["kind"], s["organization"], s["page"]) for s in got[1]] == [("profile", "", 1), ("employment", "ООО Ромашка", 2), ("employment", "Лютик", 3), ("skills", "", 3), ("about", "", 3)]
    assert got[1][0]["content"] == "Иван Петров\nинженер" and got[1][1]["content"].endswith("продолжение")


def test_resume_parts(spark):
    job = "Май 2020\nРомашка\nТехнологии\nSpark\n" + "слово " * 1000
    rows = spark.createDataFrame([(job, "employment", " Ромашка "), ("short", "skills", ""), ("", "about", "")], "content string, kind string, employer string")
    got = [r["p"] for r in rows.select(resumes.parts(F.col("content"), F.col("kind"), F.col("employer")).alias("p")).collect()]
    assert got[1] == ["short"] and got[2] == []
    assert len(got[0]) == 3 and all(len(p) <= 2200 and p.startswith("Организация: Ромашка\nТехнологии\nSpark\n") for p in got[0])
    assert one(spark, F.length(resumes.excerpt(F.repeat(F.lit("x"), 9000), F.col("k"), 50)), k="skills") == 8000
    assert one(spark, F.length(resumes.excerpt(F.repeat(F.lit("x"), 9000), F.col("k"), 50)), k="page") == 50


@pytest.mark.parametrize(("message", "want"), [("Уточни, что на фото", True), ("Уточни срок", False), ("Какой фон?", True), ("В каком формате?", False), ("Какая форма у листа?", True)])
def test_picture_intent(spark, message, want):
    assert one(spark, resumes.asks_picture_again(F.col("m")), m=message) is want


def test_prompt(spark):
    sources = F.array(F.struct(F.lit("T").alias("title"), F.lit("csv").alias("source_type"), F.lit("a.csv").alias("file_name"), F.array(F.lit("x")).alias("features"), F.lit(" body ").alias("content")))
    got = one(spark, resumes.prompt(F.col("q"), sources, ["be short"], F.lit(" "), F.lit("copy numbers")), q="why?")
    assert got == "Rules:\n- be short\n\nContext:\n\n[Source 1: csv | title=T | file=a.csv | feature=x]\nbody\n\nReminder:\ncopy numbers\n\nQuestion:\nwhy?"
