"""Literal inputs for aliases, boosts of test pairs, promotions and sampled pairs."""

import pytest

from rankweave.operators import curate, fusion, listwise


def test_aliases_take_the_longest_suffix_then_the_nearest_readable_name(spark):
    now = [("cirq-core/cirq/foo/bar.py", True), ("other/foo/bar.py", True), ("a/__init__.py", True), ("a/b/__init__.py", True), ("x/y/lost.py", False), ("xx/y/lost.py", True)]
    old = ["cirq/foo/bar.py", "foo/bar.py", "a/b/__init__.py", "nowhere.py", "x/y/lost.py", "very/long/other/folder/y/lost.py"]
    got = curate.resolve_aliases(spark.createDataFrame([("r", x) for x in old], "repo string, old string"), spark.createDataFrame([("r", *x) for x in now], "repo string, path string, readable boolean"))
    assert {x.old: x.path for x in got.collect()} == {
        "cirq/foo/bar.py": "cirq-core/cirq/foo/bar.py",
        "foo/bar.py": "other/foo/bar.py",
        "a/b/__init__.py": "a/b/__init__.py",
        "nowhere.py": None,
        "x/y/lost.py": None,  # the nearest name is itself, which can't be read
        "very/long/other/folder/y/lost.py": None,
    }


def test_test_pairs_lend_each_other_half_their_score(spark):
    rows = [("d/a.py", 1, 2.0), ("d/test_a.py", 2, 1.0), ("d/b_test.py", 3, -4.0), ("d/b.py", 4, 3.0), ("d/tests/test_a.py", 5, 6.0), ("d/c.py", 6, 1.0)]
    ranked = spark.createDataFrame([("r", "i", *x) for x in rows], "repo string, issue_id string, path string, rank int, score double")
    got = {x.path: x.score for x in fusion.testpair_boost(ranked).collect()}
    # a.py takes its last test's score; a negative pair lends nothing
    assert got == {"d/a.py": 5.0, "d/test_a.py": 2.0, "d/b_test.py": -2.5, "d/b.py": 3.0, "d/tests/test_a.py": 7.0, "d/c.py": 1.0}


@pytest.mark.parametrize(
    "relevance, original, want",
    [
        ([0] * 8, 2, "abcdefgh"),
        ([9, 9, 0, 0, 0, 0.5, 0, 0.4], 2, "abfcdheg"),  # the best goes behind the original two, the next to the sixth place
        ([0, 0, 0, 0, 0, 0, 0.25, 0.22], 2, "abcdeghf"),  # under the first threshold, over 0.7 of it
        ([0] * 6 + [1, 1], 7, "abcdhefg"),
    ],
)
def test_promote(spark, relevance, original, want):
    assert promoted(spark, relevance, original) == want


def promoted(spark, relevance, original, **limits):
    rows = [("r", "i", chr(97 + i), i + 1, float(x)) for i, x in enumerate(relevance)]
    found = listwise.promoted(spark.createDataFrame(rows, "repo string, issue_id string, path string, rank int, relevance double").repartition(3), original, **limits)
    return "".join(r["path"] for r in found.orderBy("rank").collect())


def test_promote_past_the_last_place(spark):
    # three go behind the first three: to the fourth and fifth place, the third to the fifth before the second
    assert promoted(spark, [0] * 8 + [0.9, 0.8, 0.7], 3, top5=3, top10=0) == "abcikjdefgh"
    # the original ones fill the first five places, so what moves up stands at the fifth, the last first
    assert promoted(spark, [0] * 6 + [0.9, 0.8], 6, top5=2, top10=0) == "abcdhgef"
    # six of the second kind: the fifth and the sixth share the tenth place
    assert promoted(spark, [0] * 9 + [0.29, 0.28, 0.27, 0.26, 0.25, 0.24], 2, top10=6) == "abcdejklmonfghi"


def test_sampled_pairs_are_no_edges_and_no_more_than_asked(spark):
    files = spark.createDataFrame([("r", f"f{i:02}") for i in range(12)] + [("s", "x"), ("s", "y")], "repo string, path string")
    edges = spark.createDataFrame([("r", "f00", f"f{i:02}") for i in range(1, 9)] + [("s", "x", "y")], "repo string, a string, b string")
    rows = [tuple(x) for x in curate.sampled_pairs(edges, files, 1, 4).collect()]
    pos = {x[:3] for x in rows if x[3]}
    neg = [x[:3] for x in rows if not x[3]]
    assert len(pos) == 9 and len(neg) == len(set(neg)) and 0 < len(neg) <= 8
    assert not pos & set(neg) and all(x[0] == "r" and x[1] < x[2] for x in neg)  # s has no pair without an edge
    assert sorted(rows) == sorted(tuple(x) for x in curate.sampled_pairs(edges.repartition(3), files, 1, 4).collect())
