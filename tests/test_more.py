"""Tokenizers on literals, diffs as rows, listwise windows, blocks of dense queries and shared lexical queries."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from rankweave.functions import text as t
from rankweave.functions.patch import patch_lines
from rankweave.operators import listwise
from rankweave.operators import retrieval as r
from rankweave.sources.scratch import fresh_folder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenizers_by_their_rules(spark):
    code = F.lit("class HTTPServer: self.load_data(title, fooBar2)")
    assert one(spark, t.tok_code_strict(code)) == ["http", "server", "load", "data", "title", "foo", "bar2"]
    assert one(spark, t.tok_code_v2(code)) == ["http", "server", "load", "data", "foo", "bar2"]
    source = F.lit('def runAll(x):  # a comment\n    """doc string"""\n    return my_name + OtherThing')
    assert one(spark, t.tok_code_pystrip(source)) == ["run", "all", "my_name", "other", "thing"]
    assert one(spark, t.tok_path_improved(F.lit("src/my-app/fileName.py"))) == ["src", "my", "app", "file", "name", "file", "name", "src", "my", "app", "src.my-app.filename"]
    issue = F.lit("Title: MyClass breaks `the_name` in a.b.c and \"x.y\" see lib/fooBar.py")
    assert one(spark, t.tok_issue_v2(issue)) == ["breaks", "the_name", "see", "lib", "foo", "bar", "lib", "foo", "bar", "the_name"]
    assert one(spark, t.tok_query_strict(F.lit("`abc` and 'a.b' in p.q.r"))) == ["abc", "abc", "p", "q", "r"]
    assert one(spark, t.tok_query_chunk(F.lit("see 'a1.b2' x.yy"))) == ["see", "a1", "b2", "yy", "a1", "b2", "a1", "b2", "a1", "b2", "yy", "a1", "b2", "yy"]
    assert sorted(one(spark, t.tok_query_enhanced(F.lit('File "/x/modName.py", line 1, in run_it\nValueError')))) == sorted(["file", "mod", "name", "py", "line", "run", "it", "value", "error"] + ["modname"] * 4 + ["modname", "py"] * 3 + ["value", "error"] * 4 + ["run_it"] * 2 + ["modname"] * 3)


def test_patch_lines(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -3,3 +3,4 @@\n x\n-old\n+new\n+more\n y\n@@ -20 +21 @@ def f\n-z\n+w\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1,1 +1,0 @@\n-q"
    rows = patch_lines(spark.createDataFrame([("i", diff), ("j", ""), ("k", None)], "id string, patch string"), ["id"])
    got = {(x["file"], x["sign"], x["old"] if x["sign"] == "-" else x["new"]) for x in rows.where("sign <> ' '").collect()}
    assert got == {("a.py", "-", 4), ("a.py", "+", 4), ("a.py", "+", 5), ("a.py", "-", 20), ("a.py", "+", 21), ("b.py", "-", 1)}


def test_windows_slide_from_the_bottom(spark):
    def slide(items, window, step):
        return spark.range(1).select(listwise.slid(F.array(*map(F.lit, items)).cast("array<int>"), window, step)).first()[0]

    def spans(n, window, step):
        return spark.range(1).select(listwise.starts(F.lit(n), window, step)).first()[0]

    assert slide([5, 4, 3, 2, 1, 0], 4, 2) == [0, 1, 4, 5, 2, 3]
    assert spans(6, 4, 2) == [2, 0] and spans(20, 10, 5) == [10, 5, 0] and spans(9, 4, 2) == [5, 3, 1, 0] and spans(3, 9, 9) == [0]
    assert slide([7], 4, 2) == [7] and slide([], 4, 2) == []
    assert slide([2, 1], 9, 9) == [1, 2]
    with pytest.raises(ValueError, match="step"):
        slide([1, 2, 3], 3, 4)


def test_dense_queries_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "doc long, v array<double>")
    q = v.where("doc % 3 = 0").withColumnRenamed("doc", "query")
    whole = sorted(r.dense_topk(v, q, 4).collect())
    monkeypatch.setattr(r, "QUERY_BLOCK", 3)
    assert sorted(r.dense_topk(v, q, 4).collect()) == whole and len(whole) == 80


def test_equal_questions_share_a_list(spark):
    docs = spark.createDataFrame([("r", 1, ["a", "b"]), ("r", 2, ["a", "c", "c"]), ("s", 3, ["a"])], "repo string, doc long, w array<string>")
    asked = spark.createDataFrame([("r", "x", ["a", "zz"]), ("r", "y", ["yy", "a"]), ("r", "z", ["q"]), ("s", "u", ["a"])], "repo string, q string, tokens array<string>")
    posts = r.postings(docs, F.col("w"), ["repo"])
    groups, members = r.shared_queries(posts, asked, ["repo"], "q")
    assert groups.count() == 2 and members.count() == 4 and members.where("group IS NULL").select("q").first()["q"] == "z"
    shared = members.join(r.bm25(posts, groups, ["repo"], ["repo", "group"]), ["repo", "group"]).select("q", "doc", "score")
    assert sorted(shared.collect()) == sorted(r.bm25(posts, asked, ["repo"], ["q"]).select("q", "doc", "score").collect())


def test_scratch_folders_are_new(spark):
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")


def test_dense_search_with_copies_and_odd_vectors(spark, monkeypatch):
    """The same rows as scores of all pairs, through groups of bounded size; copies, null and short vectors included."""
    rng = np.random.default_rng(5)
    v = [(i, None if i == 7 else rng.integers(-3, 4, 2 if i == 9 else 3).astype(float).tolist()) for i in range(60)] + [(i, [1.0, 2.0, 0.5]) for i in range(60, 90)]
    v = spark.createDataFrame(v, "doc long, v array<double>")
    q = v.where("doc % 4 = 3").withColumnRenamed("doc", "query")
    pairs = v.select("doc", r.normalised("v").alias("v")).crossJoin(q.select("query", r.normalised("v").alias("q"))).where("doc <> query")
    want = r.topk(pairs.select("query", "doc", F.round(r.dot("v", "q"), 6).alias("score")), ["query"], 5)
    monkeypatch.setattr(r, "QUERY_BLOCK", 9)
    monkeypatch.setattr(r, "VECTOR_CHUNK", 25)
    got = r.dense_topk(v, q, 5)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_patches_are_read_within_their_rows(spark):
    """No line is shuffled, rows that share a key aren't mixed, and a file's lines come from its whole patch."""
    from rankweave.plans.file_queries import base_per_file

    one = "--- a/a.py\n+++ b/a.py\n@@ -3 +3 @@\n-old\n@@ -1 +1,0 @@\n-gone\n--- a/b.py\n+++ b/b.py\n@@ -7 +7 @@\n+new"
    rows = spark.createDataFrame([("i", one), ("i", one), ("k", None)], "id string, patch string")
    found = patch_lines(rows, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["file"], x["sign"], x["old"], x["new"]) for x in found.where("sign <> ' '").collect()) == sorted([("a.py", "-", 3, 3), ("a.py", "-", 1, 1), ("b.py", "+", 7, 7)] * 2)
    per = base_per_file(rows.distinct(), ["id"])
    assert [tuple(x) for x in per.collect()] == [("i", "a.py", "1 3")]


def test_cosine_of_two_documents_within_a_row(spark):
    from rankweave.plans.file_queries import two_cosine

    rows = spark.createDataFrame([(1, "a b b c", "b c"), (2, "a", "z"), (3, None, None), (4, "x y", "y x")], "id long, p string, q string")
    got = two_cosine(rows, ["id"], "p", "q")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    i = (1 + np.log(1.5)) ** 2
    want = (1 * 1 + 0.5 * 1) / (np.sqrt(0.25 * i + 1 + 0.25) * np.sqrt(2))
    assert {x["id"]: x["score"] for x in got.collect()} == {1: round(want, 6), 2: 0.0, 4: 1.0}
