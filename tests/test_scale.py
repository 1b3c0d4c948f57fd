"""What is shuffled: plans and sizes that keep wide joins inside one exchange."""

import os
import re

import pytest

from rankweave.sources import fixtures

DATA = os.environ.get("RANKWEAVE_TEST_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def exchanges(df) -> list[str]:
    """The keys that df's plan shuffles rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)]


@needs_tables
def test_candidates_of_a_list_are_not_shuffled(spark):
    """Files and issues meet by customer; neither the pool nor a list is dealt by issue (as both were)."""
    assert not [k for k in exchanges(fixtures.ranked(spark, DATA, "a")) if "issue_id" in k]


@needs_tables
@pytest.mark.parametrize("how", ["inner", "full"])
def test_two_lists_side_by_side_without_a_join(spark, how):
    side = lambda x: fixtures.ranked(spark, DATA, x).select("issue_id", "path", "gt", *(f.alias(f"{f_}_{x}") for f, f_ in ((fixtures.F.col("rank"), "rank"), (fixtures.F.col("score"), "score"))))
    want = side("a").join(side("b").drop("gt"), ["issue_id", "path"], how)
    got = fixtures.ranked_pair(spark, DATA, how)
    assert not [k for k in exchanges(got) if "issue_id" in k]
    cols = ["issue_id", "path", "rank_a", "score_a", "rank_b", "score_b"]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want.select(cols).collect()))


@pytest.mark.parametrize("kind", ["lucene", "okapi"])
def test_postings_of_asked_terms_alone(spark, kind):
    """The same scores from the postings of the queries' terms; they are dealt by document only."""
    from pyspark.sql import functions as F

    from rankweave.operators import retrieval as r

    docs = spark.createDataFrame([(1, "a b b c"), (2, "b d"), (3, "e e a"), (4, ""), (5, "b z")], "doc long, text string").withColumn("tokens", F.filter(F.split("text", " "), lambda x: x != ""))
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["e", "none"])], "q long, tokens array<string>")
    want = r.bm25(r.postings(docs, F.col("tokens"), []), asked, [], ["q"], kind=kind)
    got = r.bm25(r.postings(docs, F.col("tokens"), [], asked=asked, mean=kind == "okapi"), asked, [], ["q"], kind=kind)
    assert sorted(got.collect()) == sorted(want.collect())
    few = r.postings(docs, F.col("tokens"), [], asked=asked)
    assert {x.term for x in few.collect()} == {"a", "b", "e"}
    assert not [k for k in exchanges(few.select("doc", "term", "tf", "dl")) if "term" in k and "doc" in k]


@needs_tables
def test_hits_of_the_lists_need_no_other_exchange(spark):
    """Truth and list of an issue are in one row: nothing is dealt by issue, and two models take one pass over the lists."""
    from rankweave.operators import metrics as m
    from rankweave.plans import ranking_queries as q

    got = q._two(spark, DATA)
    assert len(exchanges(got)) == len(exchanges(fixtures.lists(spark, DATA, "ab")))
    assert not [k for k in exchanges(got) if "issue_id" in k]
    truth = fixtures.changes(spark, DATA)
    want = m.flagged(fixtures.ranked(spark, DATA, "a").where("gt"), truth).join(m.flagged(fixtures.ranked(spark, DATA, "b").where("gt"), truth).select("issue_id", fixtures.F.col("hits").alias("hb")), "issue_id")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


@needs_tables
def test_first_list_of_a_file_without_a_join(spark):
    import __spark_entry__ as entry

    F = fixtures.F
    got = entry.queries()["dedup_priority"](spark, DATA)
    assert not [k for k in exchanges(got) if "issue_id" in k]
    first = [fixtures.ranked(spark, DATA, x).where("rank <= 5").select("issue_id", "path", F.lit(x).alias("source")) for x in "abc"]
    want = first[0].unionByName(first[1]).unionByName(first[2]).groupBy("issue_id", "path").agg(F.min("source").alias("source"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_cochange_pairs_are_dealt_by_file_once(spark):
    """Pairs are formed where a file's companions meet; they were joined by issue and dealt by both files."""
    from rankweave.operators import graph as g

    rows = [("r", "1", "x"), ("r", "1", "y"), ("r", "1", "y"), ("r", "2", "x"), ("r", "2", "y"), ("r", "3", "x"), ("q", "4", "x"), ("q", "4", "z"), ("q", "4", None)]
    changes = spark.createDataFrame(rows, "repo string, issue_id string, path string")
    found = g.cochange(changes, "directional", 1)
    assert sorted(map(tuple, found.collect())) == [("q", "x", "z", 1, 1.0), ("q", "z", "x", 1, 1.0), ("r", "x", "y", 2, 0.666667), ("r", "y", "x", 2, 1.0)]
    assert not [k for k in exchanges(found) if "a," in k and "b" in k.split(", ")]


def test_neighbours_meet_their_seeds_by_issue(spark):
    from rankweave.operators import graph as g

    seed = spark.createDataFrame([("r", "1", "x"), ("r", "1", "y"), ("r", "2", "x")], "repo string, issue_id string, path string")
    edges = spark.createDataFrame([("r", "x", "y", 0.5), ("r", "x", "z", 0.25), ("r", "y", "z", 0.75)], "repo string, a string, b string, score double")
    top = g.best(g.neighbours(seed, edges, fixtures.F.col("score")), fixtures.F.max("w"), 5)
    assert sorted((x.issue_id, x.path, x.score, x["rank"]) for x in top.collect()) == [("1", "z", 0.75, 1), ("2", "y", 0.5, 1), ("2", "z", 0.25, 2)]
    assert not [k for k in exchanges(top) if "issue_id" in k and "path" in k]


@needs_tables
def test_candidates_meet_their_text_without_a_join(spark, monkeypatch):
    """An issue's text is made in its list's row (it was joined to every candidate)."""
    from rankweave.operators import predictability
    from rankweave.plans import predict_queries as q

    F, seen = fixtures.F, []
    monkeypatch.setattr(predictability, "by_columns", lambda rows, *a: seen.append(rows) or rows)
    q._lexical(spark, DATA)
    assert not [k for k in exchanges(seen[0]) if "issue_id" in k]
    asked = fixtures.issue_texts(spark, DATA).select("issue_id", F.array_distinct(F.split(F.trim(F.lower("text")), r"\s+")).alias("asked"))
    words = F.array_distinct(F.filter(F.split(F.lower("path"), r"[/._\-]"), lambda x: x != ""))
    want = fixtures.ranked(spark, DATA, "a").join(asked, "issue_id", "left").select("issue_id", F.size(words).cast("double").alias("n_words"), F.coalesce(F.size(F.array_intersect(words, "asked")), F.lit(0)).cast("double").alias("shared"))
    assert sorted(map(tuple, seen[0].select("issue_id", "n_words", "shared").collect())) == sorted((a, b, max(c, 0.0)) for a, b, c in want.collect())


@pytest.mark.parametrize("expected", [2, 1000])
def test_files_of_the_directories_beside(spark, expected):
    """The three first by hash, with a bound that is too low for some directories and with one that keeps all."""
    import hashlib

    from rankweave.plans import pool_queries as q

    paths = [f"u{i % 2}/d{i % 5}/f{i}.py" for i in range(60)] + ["u2/d0/x.py", "u3/d0/x.py", "u3/d1/y.py"]
    got = q.neighbours_of(spark.createDataFrame([("r", p) for p in paths], "repo string, path string"), 3, expected)
    up, folder = (lambda p: p.split("/")[0]), (lambda p: p.rsplit("/", 1)[0])
    want = []
    for o in {folder(p) for p in paths}:
        beside = sorted((hashlib.md5(f"near|{o}|{p}".encode()).hexdigest(), p) for p in paths if up(p) == o.split("/")[0] and folder(p) != o)
        want += [("r", o, p) for _, p in beside[:3]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@needs_tables
def test_issues_that_code_settles_take_one_pass_over_the_lists(spark):
    """Text, true files and both lists meet in one row: what is written is that row, and nothing of it was dealt by issue."""
    from rankweave.plans import pool_queries as q

    seen, write = [], q.written
    q.written = lambda df, what: seen.append(df) or write(df, what)
    try:
        found = {x.issue_id: x.jaccard for x in q._crucial(spark, DATA).collect()}
    finally:
        q.written = write
    assert found and not [k for k in exchanges(seen[0]) if "issue_id" in k]


@needs_tables
def test_a_directory_counts_its_files_once(spark):
    """Issues aren't joined to every file of their directory."""
    import __spark_entry__ as entry

    F = fixtures.F
    got = entry.queries()["challenge_same_dir"](spark, DATA)
    assert "isnotnull(path" not in got._jdf.queryExecution().optimizedPlan().toString() and "count(1)" in got._jdf.queryExecution().optimizedPlan().toString()
    g = fixtures.changes(spark, DATA).groupBy("repo", "issue_id").agg(F.min("path").alias("g"))
    cut = lambda c: F.regexp_extract(c, "^(.*)/", 1)
    want = g.join(fixtures.files(spark, DATA), "repo").where((cut("path") == cut("g")) & (F.col("path") != F.col("g"))).groupBy("issue_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not [k for k in exchanges(got) if k == "repo, dir" and "path" in k]


def test_a_score_of_zero_has_infinite_log_odds(spark, monkeypatch):
    """As the SQL's ln has it; such a score was null."""
    import duckdb

    from rankweave.plans import file_queries as q

    rows = [("1", "a", 0.0), ("1", "b", 0.000001), ("2", "c", 1.2), ("2", "d", 1.7)]
    monkeypatch.setattr(q, "ranked", lambda *a: spark.createDataFrame(rows, "issue_id string, path string, score double"))
    got = sorted(map(tuple, q._pointwise(spark, DATA).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE ra (issue_id VARCHAR, path VARCHAR, score DOUBLE)")
    con.executemany("INSERT INTO ra VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT issue_id, path, round(ln(score / (1.7::DOUBLE - score)), 6) AS score FROM ra WHERE score < 1.7 ORDER BY ALL").fetchall()
    assert got == want and got[0][2] == float("-inf")


#: Documents with ids that repeat, null ids and texts, and items whose passages some of them hold.
REPEATED = [(1, "the cat sat"), (1, "cat cat dog"), (2, "dog sat on the mat"), (2, "dog sat on the mat"), (3, "a bird"), (None, "cat bird"), (None, "cat"), (4, None), (5, ""), (6, "mat dog cat"), (7, "dog sat"), (7, "mat")]
ASKED = [(1, "dog sat"), (2, "cat mat cat"), (3, "none")]


def _oracle(sql):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", REPEATED)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ASKED)
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["bm25_okapi", "bm25_custom", "bm25_pathcode", "topk_stable", "bm25_func_negatives"])
def test_texts_are_dealt_once_for_an_index(spark, name, tmp_path):
    """Texts were dealt four times and more, for counts, lengths and statistics each; ids that repeat are one document, as in the SQL."""
    import __spark_entry__ as entry

    spark.createDataFrame(REPEATED, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("REPARTITION_BY_COL", plan)) == 1
    assert sorted(map(tuple, got.collect())) == _oracle(entry.oracle_sql()[name])


@pytest.mark.parametrize("digits", [1, 3])
def test_edges_are_dealt_anew_without_their_left_ends(spark, monkeypatch, digits):
    """Runs of left ends meet the edges' parts; edges were numbered twice over a whole repo, and joined by number."""
    import hashlib
    import random

    from rankweave.operators import graph as g

    monkeypatch.setattr(g, "DEALT", digits, raising=False)
    draw = random.Random(5)
    rows = [(repo, f"{repo}{i}", f"d{draw.randrange(20)}/f.py") for repo in ("r", "q") for i in range(60) for _ in range(draw.randrange(1, 5))] + [("s", "1", "x"), ("s", "2", None)]
    changes = spark.createDataFrame(rows, "repo string, issue_id string, path string")
    got = g.dealt_anew(changes)
    want = []
    for repo in ("r", "q", "s"):
        pairs = sorted({(a, b) for x, i, a in rows for y, j, b in rows if x == y == repo and i == j and a and b and a != b})
        dealt = sorted(pairs, key=lambda p: (hashlib.md5(f"edge|{p[0]}|{p[1]}".encode()).hexdigest(), p))
        want += [(repo, a, b) for (a, _), (_, b) in zip(pairs, dealt)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not [k for k in exchanges(got) if k.split(", ") == ["repo", "i"]]
