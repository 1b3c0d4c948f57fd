"""Small relations with hand-made results, and invariants."""

import pytest
from pyspark.sql import functions as F

from rankweave.functions import text
from rankweave.operators import fusion, graph, metrics, retrieval, stats
from rankweave.plans.retrieval_queries import chunk_max, multi_signal

RANKED = "repo string, issue_id string, path string, rank int, score double"


@pytest.fixture(scope="module")
def lists(spark):
    a = spark.createDataFrame([("r", "1", "x", 1, 0.9), ("r", "1", "y", 2, 0.5), ("r", "2", "z", 1, 0.4)], RANKED)
    b = spark.createDataFrame([("r", "1", "y", 1, 0.8), ("r", "1", "w", 2, 0.1)], RANKED)
    return a, b


def paths(df, issue="1"):
    return [r["path"] for r in df.where(F.col("issue_id") == issue).orderBy("rank").collect()]


def test_rrf_is_symmetric_and_favours_shared(lists):
    a, b = lists
    one = fusion.rrf(fusion.lists(a, b), [1.0, 1.0])
    two = fusion.rrf(fusion.lists(b, a), [1.0, 1.0])
    assert paths(one) == paths(two) == ["y", "x", "w"]


def test_interleave_and_gate(lists):
    a, b = lists
    assert paths(fusion.interleave(fusion.lists(a, b))) == ["x", "y", "w"]
    assert paths(fusion.gated(a, b, 0.1)) == ["x", "y"]
    assert paths(fusion.gated(a, b, 0.5)) == ["y", "w"]
    assert paths(fusion.gated(a, b, 0.5), "2") == ["z"]  # one score: the gap is infinite


def test_metrics(spark, lists):
    truth = spark.createDataFrame([("r", "1", "y"), ("r", "1", "q"), ("r", "3", "k")], "repo string, issue_id string, path string")
    got = {r["issue_id"]: r for r in metrics.flagged(lists[0], truth).select("issue_id", metrics.recall_at(5).alias("rec"), metrics.any_at(1).alias("any1"), metrics.all_at(5).alias("all5"), metrics.mrr().alias("mrr"), metrics.ap().alias("ap"), metrics.ndcg_at(5).alias("ndcg")).collect()}
    assert got["1"]["rec"] == 0.5 and got["1"]["any1"] == 0 and got["1"]["all5"] == 0 and got["1"]["mrr"] == 0.5 and got["1"]["ap"] == 0.25
    assert 0 < got["1"]["ndcg"] < 1
    assert got["3"]["rec"] == got["3"]["mrr"] == got["3"]["ndcg"] == 0


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([("g", 0.1, False), ("g", 0.5, True), ("g", 0.5, False), ("g", 0.9, True)], "k string, s double, y boolean")
    assert metrics.auc(rows, "y", "s", "k").first()["auc"] == 0.875


def test_cochange_norms(spark):
    ch = spark.createDataFrame([("r", "1", "a"), ("r", "1", "b"), ("r", "2", "a"), ("r", "2", "b"), ("r", "3", "a"), ("r", "3", "a")], "repo string, issue_id string, path string")
    directional = {(r["a"], r["b"]): r["score"] for r in graph.cochange(ch, "directional", 2).collect()}
    assert directional == {("a", "b"): 0.666667, ("b", "a"): 1.0}
    assert {r["score"] for r in graph.cochange(ch, "symmetric", 1).collect()} == {1.0}


def test_propagation_keeps_isolated_nodes(spark):
    nodes = spark.createDataFrame([("r", "1", "a", 1.0), ("r", "1", "b", 0.0), ("r", "1", "c", 0.3)], "repo string, issue_id string, path string, score double")
    edges = spark.createDataFrame([("r", "1", "b", "a", 2.0)], "repo string, issue_id string, a string, b string, w double")
    got = {r["path"]: r["score"] for r in graph.propagate(nodes, edges, 0.5, 1).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.3}


def test_bm25_prefers_rare_terms_and_is_stable(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "c")], "doc long, text string")
    q = spark.createDataFrame([(9, ["b", "a"])], "q long, tokens array<string>")
    for parts in (1, 8):
        got = retrieval.topk(retrieval.bm25(retrieval.postings(docs.repartition(parts), F.split("text", " "), []), q, [], ["q"]), ["q"], 5)
        assert [r["doc"] for r in got.orderBy("rank").collect()] == [1, 2]


def test_mcnemar_p():
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(5, 5) == 1.0
    assert round(stats.mcnemar_p(0, 10), 6) == round(2 / 1024, 6)
    assert stats.mcnemar_p(60, 20) < 1e-4


def test_bootstrap_reruns_agree(spark):
    v = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5).cast("double").alias("v"))
    one, two = stats.bootstrap(v, "k", 100).first(), stats.bootstrap(v.repartition(7), "k", 100).first()
    assert one == two and one["mean"] == 2.0 and one["lo"] < 2 < one["hi"]


def test_multi_signal_has_tests_and_sources(spark):
    """Counterparts that exist weigh 0.7, count as a kind, and aren't seeds."""
    paths = ["p/a.py", "p/tests/test_a.py", "p/test_a.py", "q/tests/test_b.py", "q/b.py", "c_test.py", "c.py", "test_d.py", "d.py", "e.py", "test_e.py"]
    every = spark.createDataFrame([("r", x) for x in paths], "repo string, path string")
    seed = spark.createDataFrame([("r", "1", x, i, 0.5) for i, x in enumerate(["p/a.py", "q/tests/test_b.py", "c_test.py", "test_d.py", "d.py"], 1)], "repo string, issue_id string, path string, rank int, score double")
    found = graph.counterparts(seed, every, F.lit(0.7))
    assert sorted((r["path"], r["w"]) for r in found.collect()) == [("c.py", 0.7), ("p/test_a.py", 0.7), ("p/tests/test_a.py", 0.7), ("q/b.py", 0.7)]
    cc = spark.createDataFrame([("r", "p/a.py", "p/tests/test_a.py", 0.5)], "repo string, a string, b string, score double")
    imp = spark.createDataFrame([("r", "p/a.py", "p/test_a.py")], "repo string, a string, b string")
    got = {r["path"]: r["score"] for r in multi_signal(seed, cc, imp, every).collect()}
    assert got["p/tests/test_a.py"] == round((0.5 + 0.7) * 1.3, 6)
    assert got["p/test_a.py"] == round((0.6 + 0.25 / 2 + 0.7) * 1.3 * 1.2, 6)
    assert got["q/b.py"] == 0.7


def test_chunks_past_a_thousand_stay_with_their_file(spark, monkeypatch):
    monkeypatch.setattr(text, "chunk_words", lambda c: F.split(c, ","))  # chunks of one word
    docs = spark.createDataFrame([(1, "a," * 1001 + "needle"), (2, "b")], "doc long, text string")
    items = spark.createDataFrame([(7, ["needle"])], "q long, tokens array<string>")
    assert [(x["q"], x["file"]) for x in chunk_max(docs, items).collect()] == [(7, 1)]
