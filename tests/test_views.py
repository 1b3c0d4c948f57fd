"""Functions by indentation, their ranking and packing, against a walk over the lines."""

import math
import re

from rankweave.operators import views as v


def walked(text):
    lines, out = text.split("\n"), []
    depth = lambda x: len(re.match(r"[ \t]*", x)[0])
    for n, x in enumerate(lines):
        if m := re.match(r"[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)[ \t]*\(", x):
            stop = next((k for k in range(n + 1, len(lines)) if lines[k].strip(" \t\r") and depth(lines[k]) <= depth(x)), len(lines))
            out.append((n, m[1], "\n".join(lines[n:stop]).rstrip(" \t\r\n")))
    return out


def bm25(bodies, query):
    docs = [(b.lower().split() + [p for p in n.lower().split("_") if p]) for n, b in bodies]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log((len(docs) - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    average = sum(map(len, docs)) / len(docs)
    return [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in query.lower().split() if w in d) for d in docs]


TEXTS = {
    1: "import os\n\ndef a_one(x):\n    y = x\n\n    def deep():\n        return 1\n    return y\n\n\nclass C:\n    async def b (self):\n        pass\n  # less\nx = 1",
    2: "def a(): pass\ndef a(): other\n\tdef t(): tab\n\t\tx\n",
    3: "no function\nundef f():\n" * 60,
    4: None,
    5: "",
    6: "def long_name():\n    " + "word " * 3000,
    7: "\n".join(f"def f{i}():\n    return {'spam' if i % 4 == 1 else 'egg'} {i}" for i in range(12)),
}


def test_functions(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "id int, text string").repartition(3)
    found = {}
    for r in v.functions(rows, ["id"]).collect():
        found.setdefault(r["id"], []).append((r["start"], r["name"], r["body"]))
    assert {k: sorted(x) for k, x in found.items()} == {k: walked(x) for k, x in TEXTS.items() if x and walked(x)}


def test_views(spark):
    query = "spam spam f3 return Y word"
    rows = spark.createDataFrame([(k, x, query) for k, x in TEXTS.items()], "id int, text string, query string").repartition(3)
    defined = v.functions(rows, ["id"])
    found = {r["id"]: r for r in v.packed(rows, v.ranked_functions(defined, rows, ["id"]), ["id"]).collect()}
    for k, x in TEXTS.items():
        own = walked(x) if x else []
        if own:
            scores = bm25([(n, b) for _, n, b in own], query)
            best = sorted(range(len(own)), key=lambda i: (-round(scores[i], 6), own[i][0]))[:5]
            want, kind = "\n\n".join(f"# {own[i][1]}\n{own[i][2]}" for i in best)[:2000], "functions"
        else:
            want, kind = ("# (file not available)", "none") if x is None else ("\n".join(x.split("\n")[:50]), "head")
        assert (found[k]["view"], found[k]["kind"]) == (want[:2000], kind), k
    assert len(found[6]["view"]) == 2000


def test_views_without_a_shuffle(spark):
    """A file's functions, scores and view are worked out in its row (texts and words were shuffled several times)."""
    query = "spam spam f3 return Y word"
    rows = spark.createDataFrame([(k, x, None if k == 2 else query) for k, x in TEXTS.items()], "id int, text string, query string")
    got = v.views(rows, ["id"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = v.packed(rows, v.ranked_functions(v.functions(rows, ["id"]), rows, ["id"]), ["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_query_of_views_shuffles_nothing(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "One a. Two b. Three a b"), (2, None), (9, "prose")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["code_view_bm25_funcs"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.kind for r in got.collect()} == {1: "functions", 2: "functions", 9: "head"}
