"""Reordering by mentions on written-out lists, and names of files."""

from pyspark.sql import functions as F

from rankweave.functions import text as t
from rankweave.operators import boosts as b

TEXT = """crash in `Util.load_all` and `x`
  File "/usr/lib/python3/site-packages/pkg/a.py", line 3
  File "/home/me/other/b.py", line 9
see core/mod/c.py and setup.py, or pkg.deep.thing, e.g.some.thing http.client
"""


def listed(spark, paths, text):
    rows = spark.createDataFrame([("i", p, n + 1) for n, p in enumerate(paths)], "issue string, path string, rank int").repartition(2)
    texts = spark.createDataFrame([("i", text)], "issue string, text string")
    return [(r["path"], r["boosted"]) for r in b.reordered(rows, texts, ["issue"]).orderBy("rank").collect()]


def test_mentions(spark):
    m = spark.range(1).select(b.mentions(F.lit(TEXT)).alias("m")).first()["m"]
    assert m["frames"] == ["python3/site-packages/pkg/a.py", "/home/me/other/b.py"]  # the first installation folder counts
    assert set(m["refs"]) >= {"core/mod/c.py", "setup.py", "/home/me/other/b.py"} and set(m["names"]) == {"a.py", "b.py", "c.py", "setup.py"}
    # parts have two letters or more, and a file name is a module's form too
    assert m["modules"] == ["setup/py.py", "pkg/deep/thing.py", "pkg/deep.py", "some/thing.py"] and m["words"] == ["util", "load_all"]
    assert spark.range(1).select(b.mentions(F.lit(None).cast("string")).alias("m")).first()["m"]["refs"] == []


def test_reordered(spark):
    paths = ["x/quiet.py", "tests/a.py", "lib/b.py", "pkg/a.py", "src/pkg/deep.py", "x/util/y.py", "setup.py", "core/mod/c.py", "p/migrations/m.py", "p/__init__.py"]
    n = len(paths)
    place = {p: i for i, p in enumerate([p for p in paths if p != "tests/a.py"] + ["tests/a.py"])}
    share = {"lib/b.py": 0.8 + 0.7, "pkg/a.py": 2 + 0.7, "src/pkg/deep.py": 0.5, "x/util/y.py": 0.2, "setup.py": 1.5 - 0.3, "core/mod/c.py": 1.5, "p/migrations/m.py": -0.3, "p/__init__.py": -0.1, "tests/a.py": 0.8 + 0.7}
    want = {p: round(n * share.get(p, 0) - place[p], 6) for p in paths}
    assert listed(spark, paths, TEXT) == sorted(want.items(), key=lambda x: (-x[1], place[x[0]]))


def test_without_text(spark):
    paths = ["test_a.py", "b.py", "manage.py", "c.py"]
    for text in (None, ""):
        assert [p for p, _ in listed(spark, paths, text)] == ["b.py", "c.py", "manage.py", "test_a.py"]


def test_anonymous_names(spark):
    def h(x):
        import hashlib

        return hashlib.md5(x.encode()).hexdigest()[:8]

    want = {"a/b.py": f"a/{h('b.py')}.py", "a/é.tar.gz": f"a/{h('é.tar.gz')}.gz", "a/.hidden": f"a/{h('.hidden')}.py", "a.d/none": f"a.d/{h('none')}.py", "top.pyi": f"{h('top.pyi')}.py", "": f"{h('')}.py"}
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert dict(map(tuple, rows.select("p", t.anonymous_name("p")).collect())) == want


def walked(answer, names):
    """Places by one walk over the answer's words, which are dropped from the list as they are found."""
    import os
    import re

    def named(x, left, numbers_first):
        n, x = x.strip(), x.strip().rstrip(",").strip()  # a number with a comma behind it is no number
        by_path = [i for i in left if x.endswith(names[i]) or names[i].endswith(x)] or [i for i in left if os.path.basename(x.rstrip("/")) and os.path.basename(names[i]) == os.path.basename(x.rstrip("/"))]
        by_number = [int(n) - 1] if re.fullmatch("[0-9]+", n) and int(n) - 1 in left else []
        if numbers_first and re.fullmatch("[0-9]+", n):
            return by_number[:1]
        return (by_path or by_number)[:1]

    def read(words, numbers_first):
        left, out = list(range(len(names))), []
        for x, first in zip(words, numbers_first):
            for i in named(x, left, first):
                out.append(i)
                left.remove(i)
        return out, left

    lines = [x.strip() for x in (answer or "").strip().split("\n")]
    words = lines[0].split(",") if "," in lines[0] else lines[0].split() if re.fullmatch(r"[\d\s]+", lines[0]) and len(lines[0].split()) > 1 else []
    out, left = read([w.strip() for w in words], [True] * len(words))
    if len(out) < 2:
        heads = [(m[1].strip(), False) if (m := re.match(r"[0-9]+[.)]\s*(.+)$", x)) else (x, True) for x in lines if x]
        out, left = read([h for h, _ in heads], [f for _, f in heads])
    return out + left


def test_mixed_rankings(spark):
    import random

    rng = random.Random(4)
    names = ["a/x.py", "b/x.py", "a/b/y.py", "y.py", "c/z.py", "c/é.py"]
    answers = [None, "", "3, 1, 2", "3,1,", "2", "9, 9", "6 5\n1", "1. c/z.py\n2. a/b/y.py", "1) 5\n2) 3", "5\n\n4\n5", "q/z.py\nx.py\nx.py", "x.py, 3, repo/c/z.py", "no idea", "1. the file\n2. c/z.py/", "99999999999, 2, 4", "4,\n3,"]
    for _ in range(150):
        word = lambda: rng.choice([str(rng.randint(0, 8)), rng.choice(names), "x.py", "/r/" + rng.choice(names), "words", ""])
        answers.append(rng.choice([", ", "\n", " ", ",\n"]).join(rng.choice(["", "1. ", "2) "]) + word() for _ in range(rng.randint(1, 7))))
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, answer string").withColumn("names", F.array(*map(F.lit, names)))
    found = [r["o"] for r in rows.repartition(3).select("i", t.parse_rank_mixed("answer", "names").alias("o")).orderBy("i").collect()]
    for answer, o in zip(answers, found):
        assert o == walked(answer, names), answer
    assert rows.limit(1).select(t.parse_rank_mixed("answer", F.array().cast("array<string>")).alias("o")).first()["o"] == []
