"""The pipeline's stages hold what each decided, and agree with the operators' own queries."""

from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
from test_operators import WORD, brute_sketch, brute_sketch_components, check_packing, lowered
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import queries

SF = "/root/testdata/sf0.001"


def brute_stages(spark):
    """What each stage leaves of the documents, as {doc_id: text}: one document at a time, all pairs, and SQL for the lines."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    field = queries.quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = lambda t: 1 / (1 + np.exp(-(field.scale * queries.quality._logit(queries.quality.document_means(field, [queries.quality.line_features(t)])) + field.shift)))[0]
    rows = {k: t for k, t in rows.items() if score(t) >= 0.3}
    yield rows
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())}))
    cleaned = queries.ORACLE_SQL["op8_line_templates"].replace("sha256(t) as text_sha256", "t")
    # near copies count as one document: what recurs is counted again by units
    counted = """recurring as (select leaf, template from templated join shared using (leaf, template) left join units using (text) group by all having count(distinct coalesce(unit, text)) >= 8),
        dropped as"""
    units = """shared as (select leaf, template from templated group by all having count(distinct text) >= 8),
        held as (select distinct t.text, t.pos, strlen(replace(p.s, ' ', '')) as size, md5(array_to_string(t.tokens, ' ')) as mark from templated t join shared using (leaf, template) join parsed p using (doc_id, pos)),
        units as (select text, min(mark) as unit from held group by text having sum(size) >= 0.8 * strlen(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g'))),
        """
    cleaned = cleaned.replace("n.leaf, g.template from near n", "n.leaf, n.tokens, g.template from near n").replace("recurring as (select leaf, template from templated group by all having count(distinct text) >= 8),\n        dropped as", units + counted)
    assert "units using" in cleaned and "n.tokens" in cleaned
    rows = {k: t for k, t in con.sql(f"select doc_id, t from ({cleaned})").fetchall()}
    yield rows
    of = brute_sketch_components({k: brute_sketch(t) for k, t in rows.items()})
    rows = {k: t for k, t in rows.items() if of[k] == k}
    yield rows
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for _, text in items:
        w = WORD.findall(lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    held = lambda w: any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))
    yield {k: t for k, t in rows.items() if not held(WORD.findall(lowered(t)))}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(spark), strict=False):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(len(want))
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == want, name
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] <= sizes[3]
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing([r.asDict() for r in rows], 2048)
    assert {r["doc_id"] for r in rows} == set(want)
    model = Tokenizer.from_file(queries.packing.vocabulary())
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {k: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in want.items()}


def test_a_family_of_near_copies_leaves_one_whole_text(spark):
    """Lines that only near copies of one article share are no boilerplate; those that eight different documents share are."""
    letters = str.maketrans("0123456789", "abcdefghij")
    prose = lambda n: "\n".join(" ".join(f"{n}x{i * 31 + j * (n + 3)}" for j in range(12)) for i in range(40)).translate(letters)
    family = [(i, f"{prose(0)}\nlast line of copy {'abcdefgh'[i]}x") for i in range(8)]
    others = [(100 + n, f"{prose(n + 1)}\nall rights reserved by the house") for n in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in family + others], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    cleaned = stages["line_dedup"](spark, docs, SF)
    kept = {r["doc_id"]: r["text"] for r in stages["near_duplicates"](spark, cleaned, SF).collect()}
    assert kept == {0: family[0][1]} | {100 + n: prose(n + 1) for n in range(8)}


def test_stages_on_edges(spark):
    """Nulls, repeated ids, empty and long texts, clashing columns and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (3, "other words entirely", "en", "a", 1), (None, "no id here", "en", "a", 10), (None, "nor here, but of other words", None, "a", 10)]
    edge = spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "2 as fp", "3 as at", "4 as w", "5 as rank", "6 as _score", "7 as _hash")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, edge, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert out.count() == (5 if name == "near_duplicates" else 7), name
        assert stage(spark, edge.limit(0), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, edge, SF).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, None}
    labelled = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as id", "2 as quality", "3 as t").unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars", "id"), allowMissingColumns=True)
    assert corpus_pipeline.STAGES[0][1](spark, labelled, SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_short_lines_recur_too(spark):
    own = [f"{'abcdefghijkl'[i]}{'mnopqrstuvwx'[i]} begins a text of its own that is by far longer than what recurs in the texts" for i in range(12)]
    rows = [(i, f"{own[i]}\n\nShare\n2024\nPage {i}\n1{i} 2{i}\n Only {'abcdefghijkl'[i]}q\nAll rights  reserved.", "en", "a", 1) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, d, SF).collect()}
    assert got == {i: f"{own[i]}\n\n1{i} 2{i}\n Only {'abcdefghijkl'[i]}q" for i in range(12)}
