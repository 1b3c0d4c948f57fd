"""Literal inputs for the scalar text operators; expected values are derived by hand from each rule."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions import text as t


def one(spark, make, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return row.select(make().alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (t.tok_path_basic, "src/fooBar/test_x.py", ["src", "foo", "bar", "test"]),
        (t.tok_path_sep4, "a-b/HTTPServer.io.py", ["http", "server", "io"]),
        (t.tok_path_strict, "ab/cd_ef-gh.py", ["ab", "cd", "ef", "gh"]),
        (t.tok_path_set, "ab/ab_cd.py", ["ab", "cd", "py"]),
        (t.tok_path_java, "src/FooBarBaz.java", ["src", "foo", "bar", "baz", "java"]),
        (t.tok_code_strict, "def loadFile(self): return x1", ["load", "file", "x1"]),
        (t.tok_code_pystrip, 'x = 1 # secret\n"""doc here"""\nyy = 2', ["yy"]),
        (t.tok_issue_basic, "Title: Crash in foo_bar a", ["crash", "in", "foo_bar"]),
        (t.ext_traceback, 'File "/usr/lib/python3/site-packages/pkg/a.py", line 3', ["pkg/a.py"]),
        (t.ext_module_paths, "see pkg.mod.fn and http.client", ["pkg/mod/fn.py", "pkg/mod.py"]),
        (t.ext_paths_delimited, 'in "a/b.py:12", c.py', ["a/b.py", "c.py"]),
        (t.ext_patch_files, "diff --git a/x.py b/y.py\n+++ b/y.py\n+++ b/z.py", ["y.py", "z.py"]),
        (t.parse_pred_list, "1. `a/b.py`\n- c.py\nnothing here\n1. `a/b.py`", ["a/b.py", "c.py"]),
        (t.parse_keywords, "one, -two-; x\nthree", ["one", "two", "three"]),
        (t.test_pair, "a/b.py", ["a/test_b.py", "a/tests/test_b.py", "a/b_test.py", "a/test/test_b.py"]),
        (t.test_pair, "a/tests/test_b.py", ["a/tests/b.py", "a/b.py"]),
        (t.stem_normalize, "a/test_x_tests.py", "x"),
        (t.is_test_file, "a/conftest.py", True),
        (t.is_test_file, "a/contest.py", False),
        (t.is_junk_file, "docs/x.py", True),
        (t.has_stack_trace, "ValueError: no", True),
        (t.basename, "x.py", "x.py"),
        (t.dirname, "x.py", ""),
    ],
)
def test_scalar(spark, fn, given, want):
    assert one(spark, lambda: fn("c"), c=given) == want


def test_two_paths(spark):
    both = {"a": "x/y/f.py", "b": "x/z/f.py"}
    assert one(spark, lambda: t.dir_distance_hops("a", "b"), **both) == 2
    assert one(spark, lambda: t.shared_prefix_depth("a", "b"), **both) == 1
    assert one(spark, lambda: t.dir_distance_class("a", "b"), **both) == 1
    assert one(spark, lambda: t.basename_similarity("a", "b"), **both) == "same_name"
    assert one(spark, lambda: t.edit_distance_component("a", "b"), **both) == 1


@pytest.mark.parametrize(("text", "n", "want"), [("[B] > [A]", 3, [1, 0, 2]), ("C, A", 3, [2, 0, 1]), ("", 2, [0, 1]), ("[Z]", 2, [0, 1])])
def test_rank_letters(spark, text, n, want):
    assert one(spark, lambda: t.parse_rank_letters("c", F.col("n")), c=text, n=n) == want


@pytest.mark.parametrize(("text", "want"), [("2, 1", [1, 0, 2]), ("3. x\n1. y", [2, 0, 1]), ("none", [0, 1, 2]), ("99999999999999, 2", [1, 0, 2])])
def test_rank_numbers(spark, text, want):
    assert one(spark, lambda: t.parse_rank_numbers("c", F.lit(3)), c=text) == want


def test_chunks_keep_the_contained_tail(spark):
    assert one(spark, lambda: t.chunk_words("c", 4, 2), c="a b c d") == ["a b c d"]
    assert one(spark, lambda: t.chunk_words("c", 4, 2), c="a b c d e") == ["a b c d", "c d e", "e"]
    assert one(spark, lambda: t.chunk_words("c", 4, 2), c="") == [""]


def test_suffix_is_never_cut(spark):
    got = one(spark, lambda: t.truncate_suffix(F.split("c", " "), F.array(F.lit("y"), F.lit("z")), 3), c="a b c d")
    assert got == ["a", "y", "z"]
