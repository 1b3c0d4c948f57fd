"""Findings of round 4: what is dealt, and whole results on literal inputs."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from rankweave.operators import curate
from tests.test_scale import exchanges

DATA = os.environ.get("RANKWEAVE_TEST_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("spare", [12, -2])
def test_first_files_by_hash_as_by_brute_force(spark, spare):
    """Also where the bound is too low, so that issues meet all files once more; no pair is dealt by issue."""
    files = [(f"r{i % 2}", f"d/f{i}.py") for i in range(90)] + [("r2", "a.py"), ("r2", "b.py")]
    want = [(f"r{i % 3}", str(i), 3 + i % 4, [f"d/f{j}.py" for j in range(i, 60)]) for i in range(12)]
    got = curate.first_by_hash(spark.createDataFrame(want, "repo string, issue_id string, n int, held array<string>"), spark.createDataFrame(files, "repo string, path string"), "s", spare=spare)
    order = lambda i, p: (hashlib.md5(f"s|{i}|{p}".encode()).hexdigest(), p)
    true = {(i, p) for repo, i, n, held in want for p in sorted((p for r, p in files if r == repo and p not in held), key=lambda p: order(i, p))[:n]}
    assert {(x.issue_id, x.path) for x in got.collect()} == true


@needs_tables
@pytest.mark.parametrize("name", ["expand_random_control", "pool_existence_filter"])
def test_issues_and_their_repos_files_are_no_rows_of_a_shuffle(spark, name):
    import __spark_entry__ as entry

    assert not [k for k in exchanges(entry.queries()[name](spark, DATA)) if "issue_id" in k and "path" in k]


@needs_tables
def test_every_file_of_the_three_lists_has_a_source(spark):
    import __spark_entry__ as entry
    from rankweave.sources import fixtures

    every = fixtures.ranked(spark, DATA, "a")
    for x in "bc":
        every = every.unionByName(fixtures.ranked(spark, DATA, x))
    assert entry.queries()["dedup_priority"](spark, DATA).count() == every.select("issue_id", "path").distinct().count()


def test_a_full_ranking_holds_documents_without_a_hit(spark):
    from rankweave.operators import retrieval as r

    scored = spark.createDataFrame([(1, 7, 2.0), (2, 7, 1.0), (2, 9, 0.5)], "q long, doc long, score double")
    got = r.full_ranking(scored, spark.createDataFrame([(7,), (8,), (9,), (9,)], "doc long"), spark.createDataFrame([(1,), (2,)], "q long"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 2.0), (1, 8, 0.0), (1, 9, 0.0), (2, 7, 1.0), (2, 8, 0.0), (2, 9, 0.5)]


@needs_tables
def test_true_files_that_a_list_misses_are_candidates_of_the_anchor(spark):
    import __spark_entry__ as entry
    from rankweave.sources import fixtures

    listed = fixtures.ranked(spark, DATA, "a").select("issue_id", "path")
    missed = fixtures.changes(spark, DATA).select("issue_id", "path").join(listed, ["issue_id", "path"], "left_anti").join(listed, "issue_id", "left_semi")
    got = entry.queries()["anchor_fusion"](spark, DATA).select("issue_id", "path")
    assert missed.count() > 0 and missed.join(got, ["issue_id", "path"], "left_anti").count() == 0 and listed.count() <= got.count()


@pytest.mark.parametrize("name", ["bootstrap_paired", "bootstrap_mean", "bootstrap_cluster", "bootstrap_repo_ci"])
def test_ten_thousand_resamples(name):
    from rankweave.plans.registry import ORACLE_SQL

    assert "range(0, 10000)" in ORACLE_SQL[name]


@needs_tables
@pytest.mark.parametrize("name", ["alpha_fusion", "rrf_zero_based", "rrf_one_based", "rrf_weighted", "minmax_fusion", "interleave_fusion", "pool_matched_rrf", "score_strategies", "combined_rank"])
def test_lists_are_fused_in_the_row_of_their_issue(spark, name):
    import __spark_entry__ as entry

    assert not [k for k in exchanges(entry.queries()[name](spark, DATA)) if "issue_id" in k]


def test_best_file_of_two_scores(spark):
    """Equal scores go to the earlier file; a row counts once."""
    from rankweave.operators import fusion

    rows = spark.createDataFrame([([0.5, 0.5], [0.1, 0.2], [True, False]), ([0.25], [0.0], [False]), ([0.1, 0.2, 0.3], [1.0, 0.0, 0.0], [True, False, False])], "a array<double>, b array<double>, gt array<boolean>")
    got = fusion.best_of_pair(rows, {"a": lambda a, b: a, "sum": lambda a, b: fusion.rounded(a + b)})
    assert {tuple(x) for x in got.collect()} == {("a", 1, 3), ("sum", 1, 3)}


@needs_tables
@pytest.mark.parametrize("name", ["graph_features", "file_category", "graph_explain", "neighbors_all"])
def test_edges_reach_lists_by_customer(spark, name):
    import __spark_entry__ as entry

    assert not [k for k in exchanges(entry.queries()[name](spark, DATA)) if "issue_id" in k and "path" in k]
