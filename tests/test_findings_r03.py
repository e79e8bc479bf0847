"""What the third round's findings were about: odd letters, hot keys, many files and large groups."""

import duckdb
import pandas as pd

from pyspark.sql import functions as F

from millrace.functions import rules, text
from millrace.operators import flags, named
from millrace.plans import catalogue, scoring, services
from millrace.sources import archives, files, store
from millrace.streaming import keyed


def same_as_sql(spark, folder, query, sql, **tables):
    """Whether a query agrees with its SQL on small tables."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    got, want = query(spark, str(folder)), con.sql(sql)
    columns = sorted(want.columns)
    rows = lambda found: sorted(repr(tuple(r)) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())
    return want.fetchall()


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(texts):
    return [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], DOCUMENT


def test_lexicon_class_of_odd_letters(spark, tmp_path):
    texts = ["x" * 18 + "ß", "x" * 18 + "ﬁ", "x" * 18 + "İ", "é" * 10, " " + "x" * 19, "\x0b" + "x" * 19, "x" * 18 + "  ", "STRASSE", "Straße", "ΟΔΟΣ", "οδοσ", " a\n B ", "a b", "", " ", None]
    same_as_sql(spark, tmp_path, catalogue.lexicon_class, catalogue.ORACLE_SQL["lexicon_class"], documents=documents(texts), benchmark=([(1, "straße"), (2, "ΟΔΟΣ"), (3, "A  b"), (4, None)], "item_id long, text string"))


class Calls:
    """Stands in for a processor's handle: one value, and how often timers were set or put off."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_admission_calls_the_state_once_a_shard_and_not_once_a_window():
    handle, made = Calls(), keyed.Admission(2, 3600)
    made.init(handle)
    batch = pd.DataFrame({"scope": [f"u{i % 50}" for i in range(5000)], "window_no": [i % 100 for i in range(5000)], "request_id": range(5000), "at_us": [i % 7 for i in range(5000)]})
    out = pd.concat(made.handleInputRows((0,), iter([batch[:2000], batch[2000:]]), handle))
    want = batch.sort_values(["at_us", "request_id"]).groupby(["scope", "window_no"]).cumcount() < 2
    assert len(out) == 5000 and set(out[out["allowed"]]["request_id"]) == set(want.index[want])
    assert handle.calls == 1 and len(handle.value[0]) == 100
    assert list(made.handleExpiredTimer((0,), handle, type("E", (), {"getExpiryTimeInMs": lambda self: handle.timers.pop()})())) == [] and handle.value is None


def test_a_job_sets_one_timer_a_batch_and_not_one_a_move():
    handle, made = Calls(), keyed.JobStates(1000)
    made.init(handle)
    batch = pd.DataFrame({"at_us": [i * 1000 for i in range(300)], "event_id": [f"{i:03}" for i in range(300)], "kind": ["requested", "failed", "requested"] * 100, "ours": True, "stage": None, "error": "x"})
    (out,) = made.handleInputRows(("j",), iter([batch]), handle)
    assert len(out) == 300 and handle.calls == 1 and handle.timers == {299 + 1000}


def test_contexts_count_letters_beyond_the_basic_plane(spark):
    texts = ["😀" * 120 + " que " + "😀" * 120, "😀 que", "a" * 100 + "que" + "b" * 101, "queque", "Que", "a" * 99 + "\nQUE", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.contexts(F.col("t"), "que").alias("c")).collect()
    assert len(rows) == len(texts)
    for t, found in rows:
        low = t.lower()
        assert found == [low[max(i - 100, 0) : i + 103] for i in range(len(low)) if low.startswith("que", i)]


def test_a_name_that_many_deals_share_is_one_row_of_the_join(spark, capsys):
    deals = spark.createDataFrame([("b", f"deal-{i}", f"T {i}", ["Shared name"]) for i in range(50)] + [("c", "only", "Only", ["Own name"])], "bucket_id string, deal_code string, title string, aliases array<string>")
    said = spark.createDataFrame([(1, "the shared name"), (2, "our own name"), (3, "deal-7 or shared"), (4, "none")], "message_id long, message string")
    found = named.resolved_deal(said, deals)
    assert sorted(tuple(r) for r in found.collect()) == [(2, "c", "only"), (3, "b", "deal-7")]
    found.explain(mode="simple")
    assert "_first" in capsys.readouterr().out


def test_answers_are_not_dealt_out_by_their_scenarios(spark, capsys):
    answers = spark.createDataFrame([("s", "\u00a0 x", None, None, None), ("s", " \u00a0\n", None, None, None)], flags.ANSWER)
    table = spark.createDataFrame([("s", "filled", "response_filled", None, []), (flags.EVERY, "sized", "sources_any", None, [])], flags.RULE)
    found = flags.flagged(answers, table)
    assert [r["flags"] for r in found.orderBy("response").collect()] == [{"filled": False, "sized": False}, {"filled": True, "sized": False}]
    found.explain(mode="simple")
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_lines_of_many_files_are_numbered_through(spark, tmp_path):
    spark.range(1000).select("id").repartitionByRange(5, "id").sortWithinPartitions("id").write.json(f"{tmp_path}/x")
    read = files.numbered_lines(spark, f"{tmp_path}/x", "id long", across=True)
    assert read.select("path").distinct().count() > 1 and read.where("line <> id + 1").count() == 0 and read.count() == 1000


def test_every_letter_that_composing_changes_is_handed_over(spark):
    """Letters alone and behind each other kind: what isn't matched must be left alone by the composed form."""
    import unicodedata as u

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and u.category(chr(c)) != "Cn"]
    parted = [u.decomposition(chr(c)).split() for c in points if u.is_normalized("NFC", chr(c))]
    joined = {int(x[1], 16) for x in parted if len(x) == 2 and "<" not in x[0]} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    must = [c for c in points if c >= 0x300 and (c in joined or u.combining(chr(c)) or not u.is_normalized("NFC", chr(c)))]
    rows = spark.createDataFrame([(c, chr(c)) for c in must], "c int, t string")
    assert [hex(r["c"]) for r in rows.where(~F.regexp_like("t", F.lit(text.COMPOSING))).collect()] == []
    assert all(u.is_normalized("NFC", chr(c)) and not u.combining(chr(c)) and c not in joined for c in points if c < 0x300)


def test_keys_of_lexicons_and_strata_are_those_of_their_sql(spark, tmp_path):
    texts = ["straße", "STRASSE", "Straße", "strasse", "Caf\u00e9", "CAFE\u0301", "cafe\u0301", "a\u00a0b", "a\u2003b", "a B", " A  b", "ΟΔΟΣ", "οδοσ", "οδος", "İ", "i", "\x0bx", "x", None, "", " ", "\ud55c", "\u1112\u1161\u11ab", "\u212b", "\u00e5", "A\u030a", "ﬁ", "fi"]
    tables = {"documents": documents(texts * 3)}
    for query in ("lexicon_rules", "stratified_slice"):
        (tmp_path / query).mkdir()
        assert same_as_sql(spark, tmp_path / query, getattr(scoring, query), scoring.ORACLE_SQL[query], **tables)


def test_only_texts_that_composing_may_change_reach_python(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([("Straße für Öl, été, mañana",), ("“Да” 日本",), ("Café",), ("plain",), (None,)], "t string")
    handed = text._changed_where(F.col("t"), F.regexp_like("t", F.lit(text.COMPOSING)), counted)
    assert len(rows.select(handed.alias("x")).collect()) == 5 and seen.value == 1


def test_pages_of_a_resume_are_made_once(spark):
    plan = services.resume_parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(text") == 1


def test_a_merge_deals_out_its_texts_once(spark, tmp_path):
    path, read = str(tmp_path / "s"), lambda: sorted(tuple(r) for r in store.read(spark, path, ["id"]).collect())

    def moved(go):
        """MB that a call wrote to shuffles."""
        context = spark.sparkContext._jsc.sc()
        sizes = []
        for step in (lambda: None, go):
            step()
            context.listenerBus().waitUntilEmpty()
            found = context.statusStore().executorList(False)
            sizes.append(sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 1e6)
        return sizes[1] - sizes[0]

    rows = spark.range(2000).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256))).alias("text")).persist()
    size = rows.agg(F.sum(F.length("text"))).first()[0] / 1e6
    written = moved(lambda: store.merge(spark, path, rows, ["id"], buckets=4))
    other = rows.where("id % 10 = 0").withColumn("text", F.lit("new")).persist()
    changed = moved(lambda: store.merge(spark, path, other, ["id"], deleted=spark.range(5), buckets=4))
    rows.unpersist()
    assert written < 1.3 * size and changed < 1.3 * size
    got = read()
    assert [r[0] for r in got] == [0, *range(5, 2000)] and [r[0] for r in got if r[1] == "new"] == list(range(0, 2000, 10))


def test_archives_are_read_member_by_member(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("path"), F.concat(F.lit("n "), F.col("id").cast("string")).alias("name"), F.repeat(F.col("id").cast("string"), 50_000).cast("binary").alias("content"))
    archives.write_archives(rows.repartition(2), f"{tmp_path}/a folder")
    found = archives.read_archives(spark, f"{tmp_path}/a folder")
    assert "ReadSchema: struct<path:string>" in found._jdf.queryExecution().executedPlan().toString()  # no archive is a value
    assert sorted((r["name"], bytes(r["content"])) for r in found.collect()) == sorted((r["name"], bytes(r["content"])) for r in rows.collect())
