"""Sources, sinks, streaming and Python sources on small files."""

import json

import pytest
from pyspark.sql import functions as F

from rankweave.functions import code
from rankweave.sources import readers
from rankweave.streaming import best

SOURCE = '''import os
from a import b

class C(Base):
    """Doc."""
    def m(self, x=1):  # note
        return x

def m():
    pass

def f(*args):
    def g():
        pass
    return g

async def h():
    pass
'''


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert [r["a"] for r in readers.scan_jsonl(spark, str(p), "a int", lenient=True).collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        readers.scan_jsonl(spark, str(p), "a int").collect()


def test_trees_and_graphs(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"py_files": ["a.py", "b.py"]}, indent=1))
    assert {tuple(r) for r in readers.scan_filetree(spark, str(tmp_path)).collect()} == {("r1", "a.py"), ("r1", "b.py")}
    g = tmp_path / "g"
    g.mkdir()
    (g / "r1_rels.json").write_text(json.dumps({"file_imports": {"a.py": ["b.py", "a.py"]}, "call_graph": {"a.py:f": ["a.py:g", "c.py:h"]}}))
    assert {tuple(r) for r in readers.scan_depgraph(spark, str(g)).collect()} == {("r1", "a.py", "b.py", "import"), ("r1", "a.py", "a.py", "import"), ("r1", "a.py", "c.py", "call")}


def test_walk_and_qrels(spark, tmp_path):
    for p in ("x/a.py", ".git/b.py", "x/__pycache__/c.py", "x/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("pass\n")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.scan_repo_walk(spark, str(tmp_path / "x")).collect()] == ["a.py"]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\tc\t1\nq\td\t0\n")
    assert [tuple(r) for r in readers.scan_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q", "c", 1)]


def test_sinks(spark, tmp_path):
    rows = spark.range(3)
    with pytest.raises(ValueError, match="3 rows"):
        readers.sink_atomic(rows, str(tmp_path / "a"), 4)
    readers.sink_atomic(rows, str(tmp_path / "a"), 3)
    assert readers.pending(rows, rows.where("id < 2"), "id").count() == 1
    corpus, queries = spark.createDataFrame([("c", "t")], "_id string, text string"), spark.createDataFrame([("q", "t")], "_id string, text string")
    bad = spark.createDataFrame([("q", "zz", 1)], "query_id string, corpus_id string, score int")
    with pytest.raises(ValueError, match="corpus_id"):
        readers.sink_beir(corpus, queries, bad, str(tmp_path / "b"))
    readers.sink_beir(corpus, queries, bad.withColumn("corpus_id", F.lit("c")), str(tmp_path / "b"))


def test_running_best(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, m in enumerate((0.2, 0.7, 0.5)):
        (folder / f"{i}.json").write_text(json.dumps({"run": "r", "step": i, "hit": m}))
    stream = best.running_best(best.arrivals(spark, str(folder), "run string, step int, hit double", 1), "run", "hit", "step")
    for seen in (3, 4):
        best.start(stream, f"best{seen}", str(tmp_path / f"cp{seen}")).awaitTermination(60)
        row = spark.table(f"best{seen}").first()
        assert (row["step"], row["seen"]) == ((1, 3) if seen == 3 else (9, 4))
        (folder / "9.json").write_text(json.dumps({"run": "r", "step": 9, "hit": 0.9}))


def test_code():
    assert [(e["name"], e["kind"]) for e in code.entities(SOURCE)] == [("C", "class"), ("m", "function"), ("m", "function"), ("f", "function"), ("g", "function"), ("h", "function")]
    assert code.entities("def (")[0]["kind"] == "file" and code.entities(None) == []
    assert code.signatures(SOURCE)[:2] == ["class C(Base):", "def m(self, x=1):"]
    assert [r["id"] for r in code.corpus(SOURCE, "p.py")] == ["p.py/C/m", "p.py/f", "p.py/g"]
    assert [r["id"] for r in code.corpus(SOURCE, "p.py", extended=True)] == ["p.py/C/m", "p.py/m", "p.py/f", "p.py/f/g", "p.py/h"]
    bare = code.strip_comments(SOURCE)
    assert "note" not in bare and "Doc." not in bare and "return x" in bare
    assert code.strip_comments("def (") == "def ("
    assert code.longest_common_substring("abcd", "xbcy") == 2


def test_code_columns(spark):
    df = spark.createDataFrame([(SOURCE, "p.py"), (None, "q.py")], "src string, path string")
    got = df.select(F.size(code.ast_functions_qual("src")).alias("n"), code.extract_structure("src").alias("s"), F.size(code.ast_corpus("src", "path")).alias("c"), code.leaf_similarity(F.col("path"), F.lit("p.py")).alias("l")).collect()
    assert (got[0]["n"], got[0]["c"], got[0]["l"], got[1]["l"]) == (6, 3, 1.0, 0.75)
    assert got[0]["s"]["imports"] == ["import os", "from a import b"]
