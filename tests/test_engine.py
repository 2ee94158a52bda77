"""Scenarios of the survey engine: small tables, exact results."""

import csv
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark import providers
from quillspark.functions import text as X
from quillspark.functions.words import STOPWORDS
from quillspark.operators import assembly, communities, facets, graph, headers, neighbours, profile, rank, report, store, survey, terms, topics
from quillspark.plans import manifest as M
from quillspark.sources import csv_source


def table(spark, headers_, rows):
    schema = ", ".join(f"c{i} string" for i in range(len(headers_))) + ", row_number long"
    frame = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], schema)
    return csv_source.Table(frame, tuple(headers_), "utf-8-sig", ",")


def answers(spark, texts, **more):
    df = spark.createDataFrame([(i + 1, 0, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)], "row_number long, fragment_no int, text string" + "".join(f", {k} long" for k in more))
    return df


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- sources -------------------------------------------------------------------------------------


def write(tmp_path, data):
    p = tmp_path / "survey.csv"
    p.write_bytes(data)
    return f"file://{p}"


def test_csv_keeps_cells_as_text_and_numbers_rows(spark, tmp_path):
    t = csv_source.read_csv(spark, write(tmp_path, b'id,text,id\n007,"a\nb, c",x\nNA,,y\n1,"say ""hi""",z\n'))
    assert t.headers == ("id", "text", "id") and t.encoding == "utf-8-sig" and t.delimiter == ","
    assert rows_of(t.frame.orderBy("row_number"), "row_number", "c0", "c1", "c2") == [(1, "007", "a\nb, c", "x"), (2, "NA", None, "y"), (3, "1", 'say "hi"', "z")]
    assert t.sample(1) == [{"idx_0": "007", "idx_1": "a\nb, c", "idx_2": "x"}]


def test_csv_in_utf16_with_tabs(spark, tmp_path):
    t = csv_source.read_csv(spark, write(tmp_path, "Reason\tComment\tCount\nprice, mostly\tné\t1\nother\tx, y\t2\n".encode("utf-16")))
    assert (t.encoding, t.delimiter) == ("utf_16", "\t")
    assert rows_of(t.frame.orderBy("row_number"), "c0", "c1", "c2")[0] == ("price, mostly", "né", "1")


def test_csv_is_judged_by_all_its_bytes(spark, tmp_path):
    rows = "".join(f"{i},plain answer\r\n" for i in range(6000))
    assert len(rows) > csv_source.HEAD_BYTES
    late = ("id,text\r\n" + rows + "9,caf\u00e9 \u2019 d\u00e9j\u00e0 vu\r\n").encode("cp1252")
    t = csv_source.read_csv(spark, write(tmp_path, late))
    assert t.encoding.lower().replace("-", "_") not in ("utf_8_sig", "utf_8") and t.frame.where("c1 like '%\ufffd%'").isEmpty()
    assert t.frame.where("row_number = 6001").first()["c1"].startswith("caf") and t.frame.count() == 6001
    with pytest.raises(csv_source.IngestError, match="reexport"):
        csv_source.read_csv(spark, write(tmp_path, ("id,text\n" + rows + '9,"never ends\n').encode()))
    t = csv_source.read_csv(spark, write(tmp_path, ("id,text\n" + rows + '9,"two\nlines"\n').encode()))
    assert t.frame.where("row_number = 6001").first()["c1"] == "two\nlines"
    with pytest.raises(csv_source.IngestError, match="reexport"):
        csv_source.read_csv(spark, write(tmp_path, 'a,b\n1,"x\n'.encode("utf-16")))


def test_half_a_character_is_not_utf8():
    assert csv_source.detect_encoding("é".encode()[:1]) != "utf-8-sig"


def test_from_frame_numbers_rows_by_order(spark):
    t = csv_source.from_frame(spark.range(500).selectExpr("500 - id o", "id text"), "o")
    assert [(r["row_number"], r["c0"]) for r in t.frame.orderBy("row_number").collect()] == [(i + 1, str(499 - i)) for i in range(500)]


def test_components_of_a_long_chain(spark):
    from quillspark.operators import graph

    n = 300
    order = [(i * 7919) % n for i in range(n)]
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src long, dst long")
    assert {r["component"] for r in graph.components(e).collect()} == {0}


def test_csv_errors(spark, tmp_path):
    with pytest.raises(csv_source.IngestError, match="reexport"):
        csv_source.read_csv(spark, write(tmp_path, b'id,comment\n1,"never ends\n2,x\n'))
    with pytest.raises(csv_source.IngestError, match="empty"):
        csv_source.read_csv(spark, write(tmp_path, b"  \n"))


@pytest.mark.parametrize("data, want", [("é".encode(), "utf-8-sig"), (b"\xef\xbb\xbfa", "utf-8-sig"), ("ab".encode("utf-16"), "utf_16")])
def test_encodings(data, want):
    assert csv_source.detect_encoding(data) == want


@pytest.mark.parametrize("raw, want", [(None, {}), (" ", {}), ('{"a": ["x"], "b": "y", "c": []}', {"a": ["x"], "b": ["y"]})])
def test_filter_specs(raw, want):
    assert csv_source.parse_filters(raw) == want


@pytest.mark.parametrize("raw", ["[1]", "{", '{"a": [1]}'])
def test_bad_filter_specs(raw):
    with pytest.raises(ValueError):
        csv_source.parse_filters(raw)


# --- text ----------------------------------------------------------------------------------------


def plain_tokens(t):
    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).casefold())
    return [w for w in words if len(w) > 2 and not w.isdigit() and w not in STOPWORDS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcßÉñ'’-_ 123.,\n½")), max_size=60), min_size=1, max_size=20))
def test_tokens_equal_the_plain_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", X.tokens(F.col("t")).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: plain_tokens(t) for i, t in enumerate(texts)}


WORD = re.compile(r"\b[\w']+\b")


def plain_fragments(text):
    def valid(chunks):
        merged = []
        for c in chunks:
            w = WORD.findall(c.casefold())
            if merged and w and w[0] in X.CONTINUATIONS:
                merged[-1] = f"{merged[-1]} {c}".strip()
            else:
                merged.append(c)
        return merged if len(merged) > 1 and all(len(WORD.findall(c)) > 3 for c in merged) else [text]

    squeeze = lambda t: re.sub(r"\s+", " ", t).strip()
    sentences = [m.strip() for m in re.findall(r"[^.]+\.", text)]
    if len(sentences) >= 2 and squeeze(" ".join(sentences)) == squeeze(text):
        return valid(sentences)
    if "." in text:
        return [text]
    clauses = [m.strip() for m in re.findall(r"[^,]+,?", text) if m.strip()]
    if len(clauses) < 2 or squeeze(" ".join(clauses)) != squeeze(text):
        return [text]
    return valid([c[:-1].strip() if c.endswith(",") else c for c in clauses])


def test_fragments_equal_the_plain_rule_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", X.answer(F.col("text")).alias("t")).where("t is not null")
    extra = ["One two three four. Five six seven eight.", "one two three four, five six seven eight", "It was good. But it was far too dear. We left early that day.", "a, b", "No stop here! It goes on. Yes", "x", "one two three four, because five six seven, and eight nine ten eleven"]
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(extra)], "doc_id long, t string"))
    for r in docs.select("t", X.fragments(F.col("t")).alias("f")).collect():
        assert r["f"] == plain_fragments(r["t"])


def test_whole_answers_are_cut_into_fragments(spark):
    said = " ".join(f"This is sentence number {i} of the answer." for i in range(500))
    df = spark.createDataFrame([(1, said)], "row_number long, text string")
    assert terms.prepare(df, "text", most=None).count() == 500
    assert terms.prepare(df, "text").agg(F.sum(F.char_length("text"))).first()[0] <= 3000


def test_cleaning_and_nulls(spark):
    cells = ["  ‘quoted’' ", "N/A", " <NA> ", "﻿ok", "na' '", "None of it", None, " x ", "it´s"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, c string")
    got = [r[0] for r in df.orderBy("i").select(X.clean_cell(F.col("c"), M.NULLS)).collect()]
    assert got == ["'quoted", None, None, "ok", None, "None of it", None, "x", "it's"]


@pytest.mark.parametrize("phrase, want", [("self-service api, us", "Self-Service Api, US"), ("  best teacher. ", "Best Teacher"), ("PDF export", "PDF Export")])
def test_labels(spark, phrase, want):
    assert spark.range(1).select(X.topic_label(F.lit(phrase))).first()[0] == want


def test_comments_and_shortening(spark):
    c = X.group_comment(F.lit("Price"), F.lit(3), F.lit(8), F.array(F.lit(4), F.lit(9)))
    assert spark.range(1).select(c).first()[0] == "Price appears in 3 response(s), representing 38% of the filtered sample. Representative documents: rows 4, 9."
    assert spark.range(1).select(X.shortened(F.lit("abc  def ghi"), 8), X.slug(F.lit(" A b! "))).first() == ("abc d...", "a-b")


# --- manifests -----------------------------------------------------------------------------------


def test_diagnosis_of_a_titled_export():
    head = ("response_id", "survey_title", "question_order_number", "main_title", "full_title", "sub_title", "answer_value", "answer_number", "user_id", "country")
    rows = [(f"r{k}", "Yearly", str(q), f"Main question {q}", f"Full wording of question {q}", "sub", f"answer {k} {q}", str(q), f"u{k}", "UK") for k in range(3) for q in range(3)]
    m = M.diagnose(head, rows)
    assert m.layout == M.VERTICAL and m.assembly.keys == (0,) and m.assembly.answer == 6
    assert m.assembly.questions[:2] == (4, 3) and 1 not in m.assembly.questions


def test_diagnosis_of_a_wide_export():
    m = M.diagnose(("country", "team", "comment"), [("UK", "a", "I really like the way this works"), ("FR", "b", "It could be rather faster at times"), ("UK", "a", "Nothing to add to what I said before")])
    assert m.layout == M.WIDE and m.verbatim == (2,) and m.metadata == (0, 1)


def test_manifest_rules_and_json():
    m = M.Manifest(M.VERTICAL, (3, 3, -1), (), M.Assembly((0,), (1, 1), 2), nulls=("NA", "na", " x ")).validated()
    assert m.metadata == (3, 0) and m.assembly.questions == (1,) and m.nulls == ("NA", "x")
    assert M.Manifest.from_json(m.to_json()) == m
    old = M.Manifest.from_json('{"layout": "VERTICAL", "pivot_logic": {"index_col_indices": [0], "question_col_idx": 1, "answer_col_idx": 2}}')
    assert old.assembly == M.Assembly((0,), (1,), 2)
    for bad in (M.Manifest("TALL"), M.Manifest(M.VERTICAL), M.Manifest(M.VERTICAL, assembly=M.Assembly((0,), (0,), 1)), M.Manifest(M.WIDE, row_limit=0)):
        with pytest.raises(M.ManifestError):
            bad.validated()


def test_diagnosis_falls_back_to_rules():
    class Broken:
        def diagnose(self, headers_, rows):
            raise RuntimeError("no network")

    m = M.diagnose(("a", "b"), [("x", "y")], "ai", Broken())
    assert m.layout == M.WIDE and "RuntimeError" in m.notes[-1]
    with pytest.raises(M.ManifestError):
        M.diagnose(("a",), [("x",)], "ai")


# --- assembly ------------------------------------------------------------------------------------


def test_vertical_assembly(spark):
    head = ("Respondent ID", "Region", "Main Question", "Full Question", "Answer", "Question Order", "Answer Number")
    rows = [
        ("101", "North", "Q1", "What worked?", "first", "1", "1"),
        ("101", "North", "Q1", "What worked?", "last", "1", "2"),
        ("101", None, "Q2", "", "second question", "2", "1"),
        ("101", None, "Q2", "", "second question", "2", "1"),
        ("202", "South", "Q1", "What worked?", "n/a", "1", "1"),
        ("202", "South", "Q2", "", " ", "2", "1"),
        ("303", None, "Q1", "What worked?", "fine", "1", "1"),
        ("303", "West", "Q2", "", "NULL", "2", "1"),
    ]
    m = M.Manifest(M.VERTICAL, (0, 1), (), M.Assembly((0,), (3, 2), 4, (5, 6))).validated()
    df, metadata = assembly.transform(table(spark, head, rows), m)
    assert df.columns == ["row_number", "Respondent ID__idx_0", "Region__idx_1", "Q2", "What worked?"] and metadata == df.columns[1:3]
    assert sorted(tuple(r)[1:] for r in df.collect()) == [("101", "North", "second question", "last"), ("303", "West", None, "fine")]


def test_matrix_headers_become_families(spark):
    head = ("Respondent ID", "Question", "Answer")
    rows = [("1", f"{s}: {f}", f"{s}{f}") for s in ("Tea", "Coffee") for f in ("Taste", "Price")]
    df, _ = assembly.transform(table(spark, head, rows), M.Manifest(M.VERTICAL, (0,), (), M.Assembly((0,), (1,), 2)).validated())
    assert df.columns[2:] == ["Price | Coffee", "Price | Tea", "Taste | Coffee", "Taste | Tea"]


def test_multipart_answers_are_joined(spark):
    head = ("Response ID", "24.1: Top: Word 1", "24.2: Top: Word 2", "24.3: Top: Word 3", "Country")
    df, _ = assembly.transform(table(spark, head, [("1", "a", None, "c", "UK"), ("2", "x", "y", "z", "FR")]), M.Manifest(M.WIDE, (0, 4), (1, 2, 3)).validated())
    assert sorted(rows_of(df, "Top")) == [("a, c",), ("x, y, z",)]


def test_only_needed_columns_are_read(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_number"), F.col("text").alias("c0"), F.col("lang").alias("c1"), F.col("source").alias("c2"))
    t = csv_source.Table(d, ("text", "lang", "source"), "", ",")
    out, _ = assembly.wide(t, M.Manifest(M.WIDE, (1,), ()).validated())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string>", plan)


def test_row_limit_and_missing_columns(spark):
    t = table(spark, ("a", "b"), [("x", "y")] * 3)
    with pytest.raises(assembly.TransformError):
        assembly.transform(t, M.Manifest(M.WIDE, (0,), (1,), row_limit=2).validated())
    with pytest.raises(assembly.TransformError):
        assembly.transform(t, M.Manifest(M.WIDE, (0,), (7,)).validated())


def test_renumbering_is_consecutive(spark):
    df = spark.range(0, 100, 1, 7).select((F.col("id") * 3 + 5).alias("row_number"), F.col("id").alias("x"))
    got = sorted(rows_of(assembly.renumber(df), "row_number", "x"))
    assert got == [(i + 1, i) for i in range(100)]


def test_renumbering_keeps_all_rows_of_ranges_whose_bounds_are_sampled(spark):
    n = 200_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n * 31).alias("row_number"), F.lit("x" * 40).alias("payload"))
    got = assembly.renumber(df.withColumn("old", F.col("row_number"))).select("row_number", "old").toPandas().sort_values("row_number")
    assert got["row_number"].tolist() == list(range(1, n + 1))
    assert got["old"].tolist() == [31 * i for i in range(n)]


# --- roles ---------------------------------------------------------------------------------------

METADATA = ["Response ID__idx_0", "email address__idx_1", "Country__idx_2", "teacher name__idx_3", "user_uid__idx_4", "us states__idx_5", "my account id now__idx_6"]
NOT_METADATA = ["Country", "What is your country?__idx_2", "why this name__idx_1", "How did the service feel overall__idx_3", "comment__idx_9"]


def test_metadata_headers():
    assert all(map(headers.is_metadata, METADATA)) and not any(map(headers.is_metadata, NOT_METADATA))


def test_verbatim_roles(spark):
    n = 24
    columns = {
        "response id__idx_0": [f"{i}" for i in range(n)],
        "country__idx_1": ["UK", "FR"] * 12,
        "Why do you say that?": [f"because reason number {i} matters a lot to me" for i in range(n)],
        "Thoughts": [f"a long and varied thought, written as item {i}" for i in range(n)],
        "Score": [str(i % 10) for i in range(n)],
        "Role": ["Teacher", "Head", "Parent"] * 8,
        "Usage | Brand": ["often", "never"] * 12,
        "Permission": ["Yes", "No"] * 12,
        "Date & Time": ["January 5, 2024 3:04 PM"] * n,
        "Codes": [f"Ref {10**13 + i} code {10000 + i}" for i in range(n)],
    }
    df = spark.createDataFrame([(i + 1, *[v[i] for v in columns.values()]) for i in range(n)], ["row_number", *columns])
    metadata, verbatim, left = profile.roles(df)
    assert metadata == ["response id__idx_0", "country__idx_1"] and verbatim == ["Why do you say that?", "Thoughts"]
    assert left["Score"] == "numbers only" and left["Date & Time"] == "dates or times" and left["Codes"] == "mostly digits"


def test_small_text_columns_are_open(spark):
    df = spark.createDataFrame([(1, "It has really helped my class"), (2, "I would like more examples of it"), (3, "Nothing else comes up right now")], "row_number long, Feedback string")
    assert profile.roles(df)[1] == ["Feedback"]


def test_identifier_columns():
    assert headers.identifier_column(["Response ID", "name", "User ID__idx_3"], ["name"]) == "User ID__idx_3"
    assert headers.identifier_column(["Response ID", "Community"], []) is None


# --- facets, survey, store -----------------------------------------------------------------------


def test_filters(spark):
    df = spark.createDataFrame([(1, "UK", "a"), (2, " UK", "b"), (3, None, "a")], "row_number long, country string, team string")
    assert rows_of(facets.apply_filters(df, {"country": ["UK", " "]}), "row_number") == [(1,)]
    assert facets.apply_filters(df, {"country": [" "]}).count() == 3
    with pytest.raises(ValueError):
        facets.apply_filters(df, {"city": ["x"]})
    with pytest.raises(ValueError):
        facets.apply_filters(df, {"team": ["a"]}, ["country"])
    assert facets.by_country(df, " uk ").count() == 2


def test_facet_definitions(spark):
    df = spark.createDataFrame([(i, f"u{i}", "ab"[i % 2], f"v{i}" if i < 30 else "v") for i in range(40)], "row_number long, user_id__idx_0 string, team__idx_1 string, code__idx_2 string")
    got = rows_of(facets.definitions(df, df.columns[1:]), "column", "display_name", "value", "n", "place")
    assert got == [("team__idx_1", "Team", "a", 20, 1), ("team__idx_1", "Team", "b", 20, 2)]


def long_survey(spark):
    rows = [
        ("1", "UK", "grp", "t1", None, "G", "What’s next?", "Full: what's next?", "More help", 1),
        ("1", "UK", "grp", "t1", "cat", "G", "What’s next?", "Full: what's next?", "Most help", 2),
        ("2", "UK", "grp", "t1", "cat", "", "What’s next?", None, " ", 3),
        ("x", "FR", "grp", "t1", "cat", "G", "Other", "Other full", "none", 4),
        ("3", "FR", "grp", "t1", "cat", "G", "Other", "Other full", "Fine", 5),
    ]
    return spark.createDataFrame(rows, "user_id string, country string, country_group string, country_tier string, career_category string, career_group string, main_title string, full_title string, answer_value string, row_number long")


def test_survey_preparation(spark):
    p = survey.prepared(long_survey(spark))
    assert rows_of(p.orderBy("row_number"), "user_id", "full_title_norm") == [(1, "Full: what's next?"), (1, "Full: what's next?"), (2, "What's next?"), (None, "Other full"), (3, "Other full")]
    long = survey.answers_long(p)
    assert sorted(rows_of(survey.question_records(long, "What's next?"), "user_id", "text")) == [(1, "Most help")]
    assert rows_of(survey.question_texts(survey.select_questions(long, ["Other"]), "Other"), "user_id", "text") == [(3, "Fine")]
    assert survey.coverage(p).first().asDict() == {"total_rows": 5, "total_users": 3, "users_with_any_answer": 2, "users_with_no_answers": 1}
    wide = survey.answers_wide(long, [("Other", "Other full")])
    assert sorted(r["Other | Other full"] for r in wide.collect() if r["Other | Other full"]) == ["Fine"]


def test_backfill(spark):
    r = spark.createDataFrame([(1, "t", "x", " "), (2, "t", "y", "kept"), (3, "t", "z", None)], "user_id long, full_title string, text string, career_group string")
    s = spark.createDataFrame([(1, "t", "x", "G", "C"), (1, "t", "x", "G", "C"), (2, "t", "y", "no", "D")], "user_id long, full_title string, text string, career_group string, career_category string")
    assert sorted(rows_of(survey.backfill(r, s), "user_id", "career_group", "career_category")) == [(1, "G", "C"), (2, "kept", "D"), (3, None, None)]


def test_results_expire_and_page(spark):
    now = [0.0]
    results = store.Results(most=2, seconds=10, clock=lambda: now[0])
    df = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(1, 8)], "row_number long, team string, why string")
    a = results.save(df, ["team"], ["why"], owner="me")
    b = results.save(df, ["team"], ["why"], owner="me")
    with pytest.raises(KeyError):
        results.get(a)
    p = results.page(b, offset=2, limit=2, filters={"team": ["b"]})
    assert [r["row_number"] for r in p.rows] == [5, 7] and (p.total, p.unfiltered, p.has_more) == (4, 7, False)
    s = results.set_role(b, "team", "verbatim")
    assert s.metadata == [] and s.verbatim == ["team", "why"]
    with pytest.raises(ValueError):
        results.set_role(b, "none", "metadata")
    results.save(df, [], ["why"]), results.save(df, [], ["why"])
    with pytest.raises(KeyError):
        results.get(b)
    now[0] = 11
    assert results.expire() == 2


def test_snapshots_serve_narrower_filters_only(spark):
    results = store.Results()
    df = spark.createDataFrame([(i, "abc"[i % 3], f"t{i}") for i in range(1, 10)], "row_number long, team string, why string")
    key = results.save(df, ["team"], ["why"])
    documents = df.select("row_number", (F.col("row_number") % 2).alias("community"))
    results.snapshot(key, "community", "why", 0.9, documents, {"team": ["a", "b"]})
    assert results.narrowed(key, "community", "why", 0.9, {}) is None
    got = rows_of(results.narrowed(key, "community", "why", 0.9, {"team": ["a"]}).orderBy("community"), "community", "count", "share")
    assert got == [(0, 1, 0.3333), (1, 2, 0.6667)]


def test_results_outlive_their_session(spark, tmp_path):
    from quillspark.operators.result_tables import ResultTables

    now = [1000.0]
    folder = f"file://{tmp_path}/results"
    first, second = (ResultTables(s, folder, most=2, seconds=500, clock=lambda: now[0]) for s in (spark, spark.newSession()))
    df = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(1, 8)], "row_number long, team string, why string")
    assert first.expire() == 0
    a = first.save(df, ["team"], ["why"], owner="me")
    first.snapshot(a, "community", "why", 0.9, df.select("row_number", F.lit(0).alias("community")), {"team": ["a", "b"]})
    p = second.page(a, offset=2, limit=2, filters={"team": ["b"]})
    assert [r["row_number"] for r in p.rows] == [5, 7] and (p.total, p.unfiltered, p.has_more) == (4, 7, False)
    assert second.narrowed(a, "community", "why", 0.9, {}) is None and second.narrowed(a, "community", "why", 0.8, {"team": ["a"]}) is None
    assert rows_of(second.narrowed(a, "community", "why", 0.9, {"team": ["a"]}), "community", "count") == [(0, 3)]
    assert second.set_role(a, "team", "verbatim").verbatim == ["team", "why"] and first.get(a).metadata == []
    assert first.narrowed(a, "community", "why", 0.9, {"team": ["a"]}) is None  # the roles changed
    with pytest.raises(KeyError):
        first.get("*")
    now[0] += 100
    b = second.save(df, [], ["why"], owner="you")
    now[0] += 100
    first.get(a)  # so b is the one not used for longest
    c = second.save(df, [], ["why"], owner="they")
    assert {r["key"] for r in first.catalogue().collect()} == {a, c}
    with pytest.raises(KeyError):
        first.get(b)
    now[0] += 350
    assert second.expire() == 1 and {r["key"] for r in first.catalogue().collect()} == {c}
    assert first.delete(c) and not first.delete(c) and not [x for x in (tmp_path / "results").iterdir()]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(2, "UK", 'say "x"'), (1, "FR", "é")], "row_number long, country string, why string")
    store.write_csv(df, f"file://{tmp_path}/out", ["country"], ["why"], "verbatim_only")
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("﻿why") and '"say ""x"""' in text
    with pytest.raises(ValueError):
        store.write_csv(df, f"file://{tmp_path}/out2", ["country"], [], "verbatim_only")
    assert store.export_name("a/b.csv", "clean_data", True) == "b-clean-data-filtered.csv"


def test_community_rows_take_the_last_group(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "row_number long, t string")
    documents = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "row_number long, community long")
    order = spark.createDataFrame([(0, 0, "A"), (1, 1, "B")], "community long, place int, label string")
    assert sorted(rows_of(store.community_rows(rows, documents, order), "row_number", "community_label")) == [(1, "B"), (2, "A")]
    assert sorted(rows_of(store.with_group(rows, documents, order), "row_number", "community_group")) == [(1, "B"), (2, "A"), (3, "")]


# --- terms and ranking ---------------------------------------------------------------------------


def test_preparation_counts(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "NaN"), (4, "word"), (5, "It is good value. We use it all the time."), (6, "two words")], "row_number long, v string")
    assert terms.usable_responses(df, "v").first().asDict() == {"total": 6, "empty_or_placeholder": 3, "single_word": 1, "analysed": 2}
    assert sorted(rows_of(terms.prepare(df, "v"), "row_number", "fragment_no", "text")) == [(5, 0, "It is good value."), (5, 1, "We use it all the time."), (6, 0, "two words")]


def test_ngrams_with_documents_and_first_seen_ties(spark):
    d = answers(spark, ["zebra crossing works", "zebra crossing and apple pie", "apple pie"])
    got = rows_of(terms.top_ngrams(d, 2, 3), "term", "n", "documents")
    assert got == [("zebra crossing", 2, 2), ("apple pie", 2, 2), ("crossing works", 1, 1)]
    assert rows_of(terms.top_ngrams(d, 2, 1, tie="term"), "term") == [("apple pie",)]
    found = terms.ngram_documents(d, 2, terms.top_ngrams(d, 2, 1)).orderBy("row_number")
    assert rows_of(found, "row_number", "text") == [(1, "zebra crossing works"), (2, "zebra crossing and apple pie")]


def test_phrases_and_strengths(spark):
    d = answers(spark, ["great lesson plan", "great lesson plan", "other idea"], community=[0, 0, 1])
    assert sorted(rows_of(terms.top_phrase(d, ["community"]), "community", "phrase")) == [(0, "great lesson plan"), (1, "other idea")]
    got = rows_of(terms.top_terms(d, ["community"], 2).where("community = 0").orderBy("rank"), "term", "n", "strength")
    assert got == [("great", 2, 1.0), ("lesson", 2, 1.0)]


def test_context_phrases(spark):
    d = answers(spark, ["the price of tea rose", "the price of tea fell", "the price of tea fell"], community=[0, 0, 0])
    got = terms.chosen_phrases(terms.context_phrases(d, ["community"]), ["community"], 4).first()["phrases"]
    assert got == ["price of tea"]


def test_examples(spark):
    d = answers(spark, ["tea", "Tea", "tea and coffee", "none"], community=[0] * 4)
    t = spark.createDataFrame([(0, ["tea", "coffee"])], "community long, terms array<string>")
    assert rows_of(rank.examples(d, t, ["community"], 3).orderBy("rank"), "row_number") == [(3,), (1,), (4,)]


def test_representativeness(spark):
    d = answers(spark, ["tea tea here", "coffee tea", "nothing", "teapot", "so much more text about tea"], community=[0] * 5)
    t = spark.createDataFrame([(0, ["tea", "coffee"])], "community long, terms array<string>")
    scores = spark.createDataFrame([(4, 0, 2.0, 1)], "row_number long, fragment_no int, degree double, neighbours long")
    assert rows_of(rank.representativeness(d, t, ["community"], scores).orderBy("rank"), "row_number") == [(2,), (1,), (5,), (4,), (3,)]


def test_ranks_equal_a_window_over_whole_groups(spark):
    rows = [(None if i % 11 == 0 else ("hot" if i % 3 else f"g{i % 7}"), i % 5, i) for i in range(600)]
    d = spark.createDataFrame(rows, "g string, score int, row_number long").repartition(6)
    order = [F.desc("score"), "row_number"]
    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    got = rank.ranked(d, ["g"], order)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rank.ranked(d, ["g"], order, 2).exceptAll(want.where("rank <= 2")).isEmpty()
    assert rank.ranked(d.where("false"), ["g"], order).isEmpty()


def test_off_topic(spark):
    d = answers(spark, ["tea leaves", "weather", "alone"], community=[0, 0, 1])
    t = spark.createDataFrame([(0, "Tea", ["leaves"]), (1, "Coffee", ["beans"])], "community long, label string, terms array<string>")
    assert sorted(rows_of(rank.off_topic(d, t, ["community"]), "row_number", "off_topic")) == [(1, False), (2, True), (3, False)]


# --- graph ---------------------------------------------------------------------------------------


def test_headers_of_any_length_and_number(spark, tmp_path):
    heads = [f'Question number {i}, "quoted"\nand in two lines' for i in range(3000)]
    quoted = [["a\nb", "c"], ["1", 'say ""hm"", "ok"'], ["2", "x,y"], ["3\r\n4", "z"]]
    for name, rows, quoting in (("many", [heads, [str(i) for i in range(3000)]], csv.QUOTE_MINIMAL), ("long", [["x" * 300_000, "b"], ["1", "2"]], csv.QUOTE_MINIMAL), ("quoted", quoted, csv.QUOTE_ALL)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            csv.writer(f, quoting=quoting).writerows(rows)
        table = csv_source.read_csv(spark, f"file://{tmp_path}/{name}.csv")
        assert list(table.headers) == rows[0]
        assert [list(r)[:-1] for r in table.frame.collect()] == rows[1:]


def torn_rows(n, seed=3):
    r = random.Random(seed)
    odd = ['plain', '', 'two\nlines', 'a "b" c', '"', '5" pipe', '\n', '\n\n"\n', 'x,y\n"z",', '",\n"', 'é\n' * 40, 'c\r\nd', '""', ' " ']
    return [[str(i), r.choice(odd), r.choice(odd) + r.choice(odd)] for i in range(n)]


@pytest.mark.parametrize("end, encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "cp1252")])
def test_cells_over_line_ends_are_read_in_splits(spark, tmp_path, end, encoding):
    rows = [["n\no", "text", "more, \"text\""], *torn_rows(400)]
    with open(tmp_path / "torn.csv", "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=end).writerows(rows)
        f.write(end + "401,5\" pipe,6\" pipe" + end + end)  # quotes inside cells that aren't quoted, and empty lines
    want = [(i + 1, *(c or None for c in r)) for i, r in enumerate([*rows[1:], ["401", '5" pipe', '6" pipe']])]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in ("1500", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            t = csv_source.read_csv(spark, f"file://{tmp_path}/torn.csv", None if encoding == "utf-8" else encoding)
            assert list(t.headers) == rows[0] and t.delimiter == ","
            got = rows_of(t.frame.orderBy("row_number"), "row_number", "c0", "c1", "c2")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert got == want


def test_splits_inside_one_cell_and_folders_of_torn_files(spark, tmp_path):
    for name, body in (("b", 'k,v\n1,"' + "long\n" * 200 + '"\n2,x\n'), ("a", '\ufeff"k",v\n"3\n",y\n4,"z\n\n"'), ("c", "k,v\n")):
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = rows_of(csv_source.read_csv(spark, f"file://{tmp_path}").frame.orderBy("row_number"), "row_number", "c0", "c1")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(1, "3\n", "y"), (2, "4", "z\n\n"), (3, "1", "long\n" * 200), (4, "2", "x")]


@pytest.mark.parametrize("line, inside, after", [('a,"b', False, True), ('b",c', True, False), ('a,5" b', False, False), ('""",x', True, False), ('""', True, True), ('"a""', False, True), ("a,b", True, True), ('x" y,"z', True, True)])
def test_open_cells_at_line_ends(line, inside, after):
    from quillspark.sources import quoted_lines

    assert quoted_lines.open_after(line, inside, quoted_lines.closed_line(",")) is after


def unit(spark, vectors):
    return graph.unit_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "i long, v array<float>"), "i", "v")


def test_two_pairs(spark):
    v = unit(spark, [[1, 0], [0.99, 0.01], [-1, 0], [-0.99, -0.01]])
    found, _ = communities.run(v, 0.8, 2)
    assert sorted(rows_of(found, "node", "community")) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_mutual_and_loose_edges(spark):
    v = unit(spark, [[1, 0], [0.9, 0.436], [0.8, 0.6]])
    strict = graph.similarity_edges(v, 0.75, 1)
    assert rows_of(strict, "src", "dst") == [(1, 2)]
    assert sorted(rows_of(graph.similarity_edges(v, 0.75, 1, mutual=False), "src", "dst")) == [(0, 1), (1, 2)]


def test_language_guard(spark):
    v = unit(spark, [[1, 0], [0.75, 0.661]])
    lang = spark.createDataFrame([(0, "es"), (1, "ES ")], "node long, lang string")
    assert graph.similarity_edges(v, 0.7).count() == 1 and graph.similarity_edges(v, 0.7, languages=lang).count() == 0
    assert (graph.language_threshold(0.7), graph.split_threshold(0.7)) == pytest.approx((0.78, 0.84))


def test_blocks_give_the_same_neighbours(spark, sf):
    v = graph.unit_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    a = sorted(rows_of(graph.nearest(v, 5), "a", "b", "rank"))
    b = sorted(rows_of(graph.nearest(v, 5, block=40), "a", "b", "rank"))
    assert a == b


def test_cells_lose_no_pair_above_the_threshold(spark):
    """Vectors anywhere, vectors in groups, very many copies and one of length 0; cells and blocks of any size."""
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(20, 12))
    grouped = middles[rng.integers(20, size=500)] + 0.2 * rng.normal(size=(500, 12))
    v = unit(spark, np.concatenate([rng.normal(size=(200, 12)), grouped, np.repeat(grouped[:1], 120, 0)]))
    exact = sorted(rows_of(graph.nearest(v, 7), "a", "b", "sim", "rank"))
    for least in (0.5, 0.89, 1.0):
        want = [(a, b, r) for a, b, s, r in exact if s >= least]
        for cell, block in ((820, 2048), (40, 64)):
            assert sorted(rows_of(neighbours.neighbours_above(v, least, 7, cell=cell, block=block), "a", "b", "rank")) == want
    assert neighbours.neighbours_above(v.where("node = 1"), 0.5).count() == 0 and neighbours.neighbours_above(v.where("false"), 0.5).count() == 0


def test_vectors_that_may_meet_most_cells_are_read_in_blocks(spark, monkeypatch):
    """Vectors anywhere aren't shuffled to the cells they ask; many blocks, many copies, and what a cell leaves out give the same."""
    rng = np.random.default_rng(2)
    v = unit(spark, np.concatenate([rng.normal(size=(900, 12)), np.repeat(rng.normal(size=(1, 12)), 300, 0)])).repartition(5)
    v = graph.written(v, "vectors")
    exact = sorted(rows_of(graph.nearest(v, 7), "a", "b", "rank", "sim"))
    met, calls = neighbours._met, []
    monkeypatch.setattr(neighbours, "_met", lambda *a: calls.append(1) or met(*a))
    for least, read, cell in ((0.1, 4096, 40), (0.4, 100, 40), (0.97, 100, 300)):
        monkeypatch.setattr(neighbours, "READ", read)
        found = neighbours.neighbours_above(v, least, 7, cell=cell, **({"most_copies": 0} if least > 0.9 else {}))
        assert sorted(rows_of(found, "a", "b", "rank")) == [x[:3] for x in exact if x[3] >= least] and not calls
    far = unit(spark, np.repeat(np.eye(12), 10, 0))
    assert neighbours.neighbours_above(far, 0.9, 7, cell=10).count() == 120 * 7 and calls


def test_edges_are_found_once(spark, monkeypatch):
    v, calls = unit(spark, np.random.default_rng(3).normal(size=(60, 8))), []
    find = neighbours.neighbours_above
    monkeypatch.setattr(neighbours, "neighbours_above", lambda *a: calls.append(1) or find(*a))
    edges = graph.similarity_edges(v, 0.5)
    assert "Scan parquet" in edges._jdf.queryExecution().executedPlan().toString() and len(calls) == 1
    assert graph.degrees(edges).agg(F.sum("neighbours")).first()[0] == 2 * edges.count()


@pytest.mark.parametrize("spread", [0.25, 50.0])
def test_index_reaches_its_recall(spark, spread):
    """Where vectors lie in groups few cells are asked, where they lie anywhere nearly all; similarities are exact."""
    rng = np.random.default_rng(1)
    made = rng.normal(size=(30, 48))[rng.integers(30, size=2000)] + spread * rng.normal(size=(2000, 48))
    v = unit(spark, made)
    found = neighbours.neighbours_by_recall(v, 8, cell=64).toPandas()
    exact = graph.nearest(v, 8).toPandas()
    assert len(set(zip(found["a"], found["b"])) & set(zip(exact["a"], exact["b"]))) >= 0.9 * len(exact)
    x = made.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose((x[found["a"]] * x[found["b"]]).sum(1), found["sim"], atol=1e-9)
    q = neighbours.quantiser(v, 2000, 64, 30)
    assert q.basis.shape == (48, 30) and (neighbours.probes_for(v, 2000, q, 8, 0.95) < len(q.centres) / 3) == (spread < 1)
    assert neighbours.neighbours_by_recall(v.where("node < 1")).count() == 0


def test_noise_and_single_nodes(spark):
    assert rows_of(communities.run(unit(spark, [[1, 0]]), 0.8)[0], "community") == [(-1,)]
    v = unit(spark, [[1, 0], [1, 0.01], [0, 1], [0.01, 1], [0, 1.01], [-1, 0]])
    assert sorted(rows_of(communities.run(v, 0.9, 3)[0], "node", "community")) == [(0, -1), (1, -1), (2, 0), (3, 0), (4, 0), (5, -1)]


def plain_greedy(edges):
    """Joins of the two communities that gain most, until none gains."""
    total = sum(e[2] for e in edges)
    community = {n: n for e in edges for n in e[:2]}
    while True:
        w, k = {}, {}
        for a, b, x in edges:
            a, b = community[a], community[b]
            k[a], k[b] = k.get(a, 0) + x, k.get(b, 0) + x
            if a != b:
                w[min(a, b), max(a, b)] = w.get((min(a, b), max(a, b)), 0) + x
        best = max(((x / total - k[a] * k[b] / (2 * total * total), -a, -b) for (a, b), x in w.items()), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return community
        community = {n: -best[1] if c == -best[2] else c for n, c in community.items()}


def planted(groups=4, size=10, seed=1):
    rng = np.random.default_rng(seed)
    e = [(g * 20 + i, g * 20 + j, round(float(rng.uniform(0.4, 0.9)), 3)) for g in range(groups) for i in range(size) for j in range(i + 1, size) if rng.random() < 0.6]
    return e + [(g * 20 + int(rng.integers(size)), g * 20 + 20 + int(rng.integers(size)), 0.4) for g in range(groups - 1)] + [(900, 901, 0.5)]


@pytest.mark.parametrize("block", [100_000, 30])
def test_communities_of_one_block_and_of_many(spark, block):
    """The same whatever the partitioning; connected, named by the smallest node, near the best; blocks of few edges come near it too."""
    e = planted()
    nodes = sorted({n for x in e for n in x[:2]} | {950})
    frame, n = spark.createDataFrame(e, "src long, dst long, weight double"), spark.createDataFrame([(i,) for i in nodes], "node long")
    a, b = (dict(rows_of(communities.communities(f, n, 0.9, block_edges=block), "node", "community")) for f in (frame, frame.repartition(7, "dst")))
    assert a == b and sorted(a) == nodes and a[950] == 950 and a[900] == a[901] == 900
    assert all(c == min(i for i in a if a[i] == c) for c in set(a.values()))
    q = lambda found: communities.modularity(e, found, 0.9)
    truth = {i: i // 20 for i in nodes}
    one = {i: 0 if i < 900 else 900 for i in nodes}
    assert q(a) >= max(q(one), q({i: i for i in nodes})) and q(a) >= (1.0 if block > 1000 else 0.95) * q(truth) - 1e-9
    assert abs(communities.modularity_of(frame, spark.createDataFrame(list(a.items()), "node long, community long")).first()[0] - q(a)) < 1e-9


def test_rounds_end_when_they_add_little(monkeypatch):
    """Rounds that go on adding a trifle don't keep a graph from being condensed; a round of some blocks only doesn't end them."""

    class Nodes:
        where = drop = lambda self, *_: self
        isEmpty = lambda self: False

    values, shares = iter([0.0, 0.4, 0.3, 0.401, 0.5, 0.502, *(0.502 + i * 2e-6 for i in range(1, 90))]), []
    monkeypatch.setattr(communities, "_value", lambda *_: next(values))
    monkeypatch.setattr(communities, "_round", lambda both, nodes, blocks, turn, share, *_: shares.append(share) or Nodes())
    assert communities._settled(None, Nodes(), 5, 1.0, 0.9)[1] and shares == [1, 1, 2, 1, 1]


def test_greedy_joins_what_belongs_together(spark):
    e = [(a, b, 1.0) for g in (0, 10) for a, b in ((g, g + 1), (g + 1, g + 2), (g, g + 2))] + [(2, 10, 1.0)]
    for edges, share in ((e, 1.0), (planted(3, 8), 0.97)):
        nodes = sorted({n for x in edges for n in x[:2]})
        found = dict(rows_of(communities.greedy(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(i,) for i in nodes], "node long")), "node", "community"))
        assert communities.modularity(edges, found, 1.0) >= share * communities.modularity(edges, plain_greedy(edges), 1.0) - 1e-9
        assert all(c == min(i for i in found if found[i] == c) for c in set(found.values()))


def test_greedy_takes_few_rounds_where_many_pick_one(spark, monkeypatch):
    """A community that 120 others pick, and whose name isn't the least, takes them in steps; no further join gains."""
    edges = [(min(i, 60), max(i, 60), 1.0) for i in range(121) if i != 60] + [(200, 201, 1.0), (201, 202, 0.5)]
    written, rounds = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or written(df, name))
    nodes = spark.createDataFrame([(i,) for i in [*range(121), 200, 201, 202]], "node long")
    found = dict(rows_of(communities.greedy(spark.createDataFrame(edges, "src long, dst long, weight double"), nodes), "node", "community"))
    assert found == {i: 0 if i < 200 else 200 for i in found} and rounds.count("pairs") < 20


def test_communities_partition_the_nodes_whatever_the_partitioning(spark):
    v = graph.unit_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id", "embedding")
    a = dict(rows_of(communities.run(v, 0.35)[0], "node", "community"))
    b = dict(rows_of(communities.run(v.repartition(3), 0.35)[0], "node", "community"))
    assert a == b and len(a) == v.count() and len(set(a.values())) > 3


def test_language_split(spark):
    assigned = spark.createDataFrame([(i, 0) for i in range(5)], "node long, community long")
    e = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.8), (2, 3, 0.95), (3, 4, 0.8)], "src long, dst long, weight double")
    lang = spark.createDataFrame([(i, "es") for i in range(4)] + [(4, "en")], "node long, lang string")
    assert sorted(rows_of(graph.split_by_language(assigned, e, lang, 0.7), "node", "community")) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]


# --- topics and reports ----------------------------------------------------------------------------


def groups_of(spark, *rows):
    """(id, label, count, terms, noise) with falling strengths."""
    made = [(i, label, n, t, [(x, 1.0 / (k + 1)) for k, x in enumerate(t)], bool(noise), False) for i, label, n, t, *noise in rows]
    return spark.createDataFrame(made, "id long, label string, count long, terms array<string>, strengths array<struct<term string, strength double>>, noise boolean, ai boolean")


def test_merging_by_terms(spark):
    groups = groups_of(spark, (0, "A", 5, ["tea", "milk", "cup"]), (1, "B", 3, ["Milk", "tea", "pot"]), (2, "C", 9, ["one"]), (-1, "N", 2, ["tea", "milk"], True))
    merged, aliases = topics.merge_by_terms(groups)
    found = {r["id"]: r for r in merged.collect()}
    assert {i: r["count"] for i, r in found.items()} == {2: 9, 0: 8, -1: 2} and dict(rows_of(aliases, "id", "to")) == {0: 0, 1: 0}
    assert found[0]["terms"] == ["tea", "milk", "cup", "pot"] and found[0]["label"] == "A" and found[2]["terms"] == ["one"]
    # tea 5 + 3/2, milk 5/2 ("Milk" is another spelling), cup 5/3, pot 3/3, each over the strongest
    assert [tuple(x) for x in found[0]["strengths"]] == [("tea", 1.0), ("milk", 0.3846), ("cup", 0.2564), ("pot", 0.1538)]


def test_merging_by_label(spark):
    groups = groups_of(spark, (0, "Great Lesson Plans", 5, ["a", "b"]), (1, "Other Thing", 4, ["c"]), (2, "New Lesson Plans", 3, ["d"]), (3, "other  thing", 2, ["e"]), (4, "", 1, []), (5, " ", 1, []), (-1, "Other thing", 9, [], True))
    merged, aliases = topics.merge_by_label(groups)
    to = {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 5, -1: -1}
    assert dict(rows_of(merged, "id", "count")) == {0: 8, 1: 6, 4: 1, 5: 1, -1: 9} and dict(rows_of(aliases, "id", "to")) == to
    first = spark.createDataFrame([(7, 0), (0, 0)], "id long, to long")
    assert dict(rows_of(topics.composed(first, aliases), "id", "to")) == to | {7: 0}
    chain = groups_of(spark, *((i, f"alpha{i} beta{i} alpha{i + 1} beta{i + 1}", 100 - i, [str(i)]) for i in range(12)))
    joined, _ = topics.merge_by_label(chain)
    assert [(r["id"], r["count"], r["terms"]) for r in joined.collect()] == [(0, sum(range(89, 101)), [str(i) for i in range(12)])]


def test_analysis_of_groups(spark):
    texts = ["green tea tastes great"] * 3 + ["green tea leaves steep slowly", "weather was awful"] + ["slow internet line", "slow internet again", "internet line slow"]
    d = answers(spark, [f"{t} {i}" for i, t in enumerate(texts)], community=[0] * 5 + [1] * 3)
    placed, groups, _ = topics.analyse(d)
    assert [r["label"].split()[0] for r in groups.orderBy("id").collect()] == ["Green", "Slow"]
    assert sorted(rows_of(placed.where("community = -1"), "row_number")) == [(5,)]
    s = {r["community"]: r for r in topics.summaries(d).collect()}
    assert (s[0]["count"], s[0]["share"], s[0]["terms"][0]) == (5, 0.625, "green") and s[0]["comment"].startswith("Green Tea")
    e = {r["community"]: r["texts"] for r in topics.evidence(d, most=2).collect()}
    assert e[1][-2:] == ["slow internet again 6", "slow internet line 5"] and "internet" in e[1] and len(e[0]) <= 13
    named, fresh, _ = topics.analyse(d, labeler=lambda g, docs: spark.createDataFrame([(0, "Warm drinks people like"), (1, "")], "id long, label string"))
    assert {r["id"]: (r["label"].split()[0], r["ai"]) for r in fresh.collect()} == {0: ("Warm", True), 1: ("Slow", False)}


def test_report_files():
    r = report.Report("Title & more", "No filters", ["A: 3 responses"], [("A", ["one (1)", "two"])])
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(report.docx(r)))
    body = z.read("word/document.xml").decode()
    assert "Title &amp; more" in body and "• two" in body
    pdf = report.pdf(r)
    assert pdf.startswith(b"%PDF") and b"one \\(1\\)" in pdf
    assert [t for t, _ in report.slides(r)] == ["Title & more", "Summary", "Representative responses"]


# --- providers -----------------------------------------------------------------------------------


def test_embedding_uses_the_cache_and_keeps_rows(spark):
    df = spark.createDataFrame([(1, "tea time"), (2, "tea time"), (3, "other"), (4, None)], "row_number long, text string")
    first, cache = providers.embed(df, providers.HashedEmbedder(16))
    cache = spark.createDataFrame(cache.collect(), cache.schema)

    class Never(providers.HashedEmbedder):
        def embed(self, texts):
            raise AssertionError("all texts are cached")

    again, _ = providers.embed(df, Never(16), cache=cache)
    got = {r["row_number"]: r["embedding"] for r in again.collect()}
    assert got[1] == got[2] and got[4] is None and abs(math.fsum(x * x for x in got[3]) - 1) < 1e-6


def test_the_second_embedder_serves_where_the_first_fails():
    class Failing(providers.HashedEmbedder):
        def embed(self, texts):
            raise providers.classified(self.dimensions)

    own = providers.HashedEmbedder(8)
    assert (providers.FallbackEmbedder(Failing(401), own).embed(["good tea"]) == own.embed(["good tea"])).all()
    with pytest.raises(providers.ProviderError):
        providers.FallbackEmbedder(Failing(429), own).embed(["good tea"])


def test_retries_and_quotas():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.classified(429, "please retry in 3 s")
        return "ok"

    assert providers.with_retries(flaky, 2, sleep=waits.append) == "ok" and waits == [3.0, 3.0]
    assert providers.classified(429, "quota per day exceeded").code == "quota"
    assert providers.classified(503, headers={"Retry-After": "99"}).retry_after == 99
    assert providers.seconds_in("12.5s") == 12.5 and providers.seconds_in("soon") is None
    with pytest.raises(providers.ProviderError):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.classified(400)), 2, sleep=waits.append)


def test_translation_keeps_what_fails(spark):
    class Upper:
        def translate(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [{"hola amigo": "hello friend"}.get(t, t.upper()) for t in texts]

    df = spark.createDataFrame([(1, "hola amigo", "es"), (2, "bad", "es"), (3, "same", "fr"), (4, "x", "en")], "i long, text string, language string")
    got = {r["i"]: (r["translated_text"], r["translated"]) for r in providers.translate(df, Upper()).collect()}
    assert got == {1: ("hello friend", True), 2: ("bad", False), 3: ("same", False), 4: ("x", False)}


@pytest.mark.parametrize("label, good", [("Faster lesson planning", True), ("General feedback", False), ("lorem ipsum topic here", False), ("tea tea tea tea", False), ("Two words", False), ("Unrelated other words", False), ("Quite unrelated new words", True)])
def test_label_rules(label, good):
    assert providers.valid_label(label, ["faster planning of lessons"]) == good


def test_labelling_batches():
    class Service:
        def label(self, evidence):
            if any(g["group_id"] == 11 for g in evidence):
                raise providers.classified(400)
            return {str(g["group_id"]): "Better lesson plans" if g["group_id"] else "misc" for g in evidence}

    labelling = providers.Labelling(Service(), sleep=lambda s: None)
    found = labelling([{"group_id": i, "texts": ["lesson plans"]} for i in range(12)])
    assert len(found) == 9 and len(labelling.warnings) == 2
    assert providers.parsed_labels('{"labels": [{"group_id": "1", "label": " \\"Good tea.\\" "}, {"group_id": "9", "label": "x"}]}', ["1"]) == {"1": "Good tea"}
    assert providers.consolidated({"1": "a", "2": "b", "3": "c"}, [{"group_ids": ["1", "2", "7"], "label": "Better lesson plans"}]) == {"1": "Better lesson plans", "2": "Better lesson plans", "3": "c"}


def test_language_guess(spark):
    df = spark.createDataFrame([("The cat and the dog of the house",), ("Der Hund und die Katze",), ("short",)], "t string")
    assert [r[0] for r in df.select(providers.detect_language(F.col("t"))).collect()] == ["en", "de", None]


# --- streaming -----------------------------------------------------------------------------------


def test_language_model_on_rows_it_did_not_see(spark):
    from quillspark.operators import languages

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("language"))
    model = languages.fit(d.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    assert model.languages == ("de", "en", "es", "fr") and model.table.count() <= 8000
    held = d.where("crc32(cast(doc_id as string)) % 5 = 0")
    right = languages.detected(held.withColumnRenamed("language", "truth"), model, ["doc_id"]).where("char_length(text) >= 8")
    assert right.agg(F.avg((F.coalesce("language", F.lit("")) == F.col("truth")).cast("int"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, "the"), (None, "Die Heit und der Schacht"), (2, None), (3, "12345678 ##"), (4, "the and thing of " * 3000), (5, "the nothing anding")], "k long, text string")
    got = {r["k"]: r["language"] for r in languages.detected(odd, model, ["k"]).collect()}
    assert got == {1: None, None: "de", 2: None, 3: None, 4: "en", 5: "en"}
    none = languages.detected(odd, languages.fit(d.limit(0)), ["k"])
    assert none.where("language is not null").isEmpty() and none.count() == 6


def test_files_are_ingested_as_they_arrive(spark, tmp_path):
    from quillspark.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    m = M.Manifest(M.VERTICAL, (0,), (), M.Assembly((0,), (1,), 2)).validated()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"id,question,answer\n{k},Why,old\n{k},Why,new {k}\n")
        ingest_stream(spark, f"file://{tmp_path}/in", ("id", "question", "answer"), m, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    got = sorted((r["batch"], r["cells"]["id__idx_0"], r["cells"]["Why"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(0, "0", "new 0"), (1, "1", "new 1")]


# --- the whole engine ------------------------------------------------------------------------------


def test_engine_from_file_to_report(spark, tmp_path):
    from quillspark.engine import AnalysisError, Engine, Settings

    good, slow = "The green tea tastes great in the morning", "The internet line is slow every single evening"
    lines = ["region,country,Please describe your experience"] + [f'{"NS"[i % 3 == 0]},{"UK" if i % 2 else "FR"},"{(good if i < 12 else slow)} number {"abcdefghijklmnopqrstuvwx"[i]}"' for i in range(24)]
    (tmp_path / "s.csv").write_text("\n".join([*lines, "N,UK,n/a", "N,UK,fine"]) + "\n")
    engine = Engine(spark, Settings(threshold=0.7))
    key = engine.ingest(f"file://{tmp_path}/s.csv", owner="me")
    s = engine.results.get(key)
    assert s.metadata == ["region__idx_0", "country__idx_1"] and s.verbatim == ["Please describe your experience"]
    column = s.verbatim[0]
    found = engine.analyse(key, column)
    groups = {r["label"]: r["count"] for r in found.groups.collect()}
    assert sorted(groups.values()) == [12, 12] and any("Tea" in g for g in groups)
    assert found.edges.count() > 0 and found.points.count() == 24 and any("single-word" in w for w in found.warnings)
    first = found.groups.orderBy("community").first()["community"]
    page = engine.group_documents(found, first, 0, 5)
    assert page.total == 12 and len(page.rows) == 5 and page.has_more
    narrowed = engine.analyse(key, column, filters={"country__idx_1": ["UK"]})
    assert sorted(r["count"] for r in narrowed.groups.collect()) == [6, 6]
    grams = engine.analyse(key, column, "ngrams")
    top = grams.ngrams.where("ngram_size = 2").orderBy("rank" if "rank" in grams.ngrams.columns else "term").first()
    assert engine.ngram_documents(grams, 2, top["term"]).total == top["documents"]
    for kind, mark in (("docx", b"PK"), ("pptx", b"PK"), ("pdf", b"%PDF")):
        assert engine.report(found, "Tea & line", kind).startswith(mark)
    assert engine.report(grams, "Terms", "docx").startswith(b"PK")
    assert engine.translate(["hola"], "es") == ["hola"] and "rule_based" in engine.config()["modes"]
    with pytest.raises(AnalysisError):
        engine.analyse(key, "country__idx_1")
    with pytest.raises(AnalysisError):
        engine.analyse(key, column, "magic")
    assert engine.facets(key).where("column = 'country__idx_1'").count() == 2
    assert engine.rows(key, limit=3).total == 25
    engine.set_role(key, "country__idx_1", "verbatim")
    assert engine.delete(key)


def test_principal_layout_equals_the_decomposition(spark):
    import numpy as np

    from quillspark.operators import graph

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) * np.array([9, 5, 2, *[1] * 9])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, v array<double>")
    got = np.array([(r["x"], r["y"]) for r in graph.principal_layout(v).orderBy("node").collect()])
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    for k in (0, 1):
        want = x @ axes[k] * np.sign(axes[k][np.argmax(np.abs(axes[k]))])
        assert np.allclose(got[:, k], want, atol=1e-2)
    assert graph.principal_layout(v.where("false")).count() == 0
    one = spark.createDataFrame([(1, [0.5])], "node long, v array<double>")
    assert graph.principal_layout(one).count() == 1


def test_forces_show_the_graph_better_than_the_axes(spark):
    from quillspark.operators import layout

    r, groups, size = np.random.default_rng(5), 5, 16
    n = groups * size
    centres = r.normal(size=(groups, 12))
    v = unit(spark, [centres[i // size] + r.normal(scale=0.3, size=12) for i in range(n)])
    links = {(i, g * size + (i + step) % size) for i in range(n) for g in [i // size] for step in (1, 3)} | {(g * size, g * size + size + 4) for g in range(groups - 1)}
    e = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in sorted(links)], "src long, dst long, weight double").dropDuplicates(["src", "dst"])
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for a, b in links:
        far[a, b] = far[b, a] = 1
    for k in range(n):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])

    def stress(places):
        at = np.array([list(x) for x in rows_of(places.orderBy("node"), "x", "y")])
        d, upper = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)), np.triu_indices(n, 1)
        d, want = d[upper], far[upper]
        scale = (d / want).sum() / (d * d / want**2).sum()
        return float((((scale * d - want) / want) ** 2).mean())

    axes = graph.principal_layout(v)
    before, pulled, after = stress(axes), stress(graph.pulled_layout(axes, e)), stress(layout.forced_layout(axes, e))
    print("stress", before, pulled, after)
    assert after < 0.8 * min(before, pulled)


def test_forces_at_the_edges(spark):
    from quillspark.operators import layout

    e = spark.createDataFrame([(1, 2, 1.0), (5, 6, 1.0)], "src long, dst long, weight double")
    assert layout.forced_layout(spark.createDataFrame([], "node long, x double, y double"), e, rounds=1).count() == 0
    one = spark.createDataFrame([(7, 2.0, 3.0)], "node long, x double, y double")
    assert rows_of(layout.force_round(one, e), "node", "x", "y") == [(7, 2.0, 3.0)]
    same = spark.createDataFrame([(k, 1.0, 1.0) for k in range(30)], "node long, x double, y double")
    assert layout.forced_layout(same, e, rounds=2).select("x", "y").distinct().count() == 30


def test_outputs_are_translated_for_display(spark):
    from quillspark import providers

    class Loud:
        def translate(self, texts):
            return [t + " x" for t in texts]

    df = spark.createDataFrame([(1, " eins ", False), (2, "zwei", True), (3, "  ", None), (4, None, None), (5, "eins", None)], "id int, label string, ai boolean")
    from pyspark.sql import functions as F

    out = {r["id"]: (r["label"], r["source_label"], r["translated"]) for r in providers.translate_outputs(df, Loud(), "label", F.col("ai")).collect()}
    assert out == {1: ("eins x", "eins", True), 2: ("zwei", None, False), 3: ("  ", None, False), 4: (None, None, False), 5: ("eins x", "eins", True)}
    assert providers.translate_outputs(df.where("false"), Loud()).count() == 0


def test_equal_texts_in_english_are_not_translated(spark):
    from quillspark import providers

    class Loud:
        def translate(self, texts):
            return [t + " x" for t in texts]

    df = spark.createDataFrame([(1, "chat", "en"), (2, "chat", "fr")], "id int, text string, language string")
    assert {r["id"]: r["translated_text"] for r in providers.translate(df, Loud()).collect()} == {1: "chat", 2: "chat x"}


def test_too_many_questions_are_an_error(spark, monkeypatch, tmp_path):
    from quillspark.operators import assembly
    from quillspark.plans import manifest as M
    from quillspark.sources.csv_source import read_csv

    path = tmp_path / "v.csv"
    path.write_text("respondent id,question,answer\n" + "".join(f"{i},question {i},some answer {i}\n" for i in range(6)))
    table = read_csv(spark, f"file://{path}")
    m = M.Manifest(layout=M.VERTICAL, metadata=(0,), assembly=M.Assembly(keys=(0,), questions=(1,), answer=2))
    assert len(assembly.vertical(table, m)[0].columns) > 6
    monkeypatch.setattr(assembly, "MOST_QUESTIONS", 5)
    with pytest.raises(assembly.TransformError):
        assembly.vertical(table, m)


def test_ranks_come_back_to_texts_and_tables_of_groups_of_any_size(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"g{i % 50}", i % 5, i, f"text {i % 9}") for i in range(600)]
    d = spark.createDataFrame(rows, "g string, score int, row_number long, text string").repartition(5)
    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "row_number")).cast("long"))
    got = rank.ranked(d, ["g"], [F.desc("score"), "row_number"], payload=["text"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    same = spark.createDataFrame([("a", "x")] * 7, "g string, text string")
    assert sorted(r["rank"] for r in rank.ranked(same, ["g"], [], payload=["text"]).collect()) == list(range(1, 8))
    groups = spark.createDataFrame([(f"g{i}", i) for i in range(0, 50, 3)] + [("hot", -1), ("none", 0)], "g string, k int")
    joined = sorted(map(str, d.join(groups, "g").collect()))
    assert sorted(map(str, graph.join_groups(d, groups, ["g"]).collect())) == joined
    monkeypatch.setattr(graph, "MOST_GROUPS", 3)
    assert sorted(map(str, graph.join_groups(d, groups, ["g"]).collect())) == joined


def test_best_ngrams_of_one_scan(spark):
    d = answers(spark, ["red green blue", "red green blue", "", "of the", "red"], community=[0, 0, 0, 1, 0])
    got = rows_of(terms.best_ngrams(d, ["community"], 2).orderBy("community", "ngram_size", "rank"), "community", "ngram_size", "rank", "term", "n")
    assert got == [(0, 0, 1, "", 4), (0, 1, 1, "red", 3), (0, 1, 2, "green", 2), (0, 2, 1, "red green", 2), (0, 3, 1, "red green blue", 2), (1, 0, 1, "", 1)]
    assert sorted(rows_of(terms.top_phrase(d, ["community"]), "community", "phrase")) == [(0, "red green blue"), (1, "")]
