"""Co-change and dependency graphs as edge tables, and pool expansion over them.

Changes are (repo, issue_id, path). A pair of files is counted once for each issue that changed both; all
joins are on (repo, ...), so a repo's skew is AQE's to split. Nothing caps the files of an issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions import text as t


def _companions(changes: DataFrame) -> DataFrame:
    """repo, a, others: a row for each file of each issue, with all files of the issue, dealt by (repo, a)."""
    own = changes.groupBy("repo", "issue_id").agg(F.collect_set("path").alias("others"))
    return own.select("repo", F.explode("others").alias("a"), "others").repartition("repo", "a")


def _pairs(companions: DataFrame) -> DataFrame:
    return companions.select("repo", "a", F.explode("others").alias("b")).where("a <> b").groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(changes: DataFrame) -> DataFrame:
    """repo, a, b, n for ordered pairs a <> b of files changed together.

    A file's companions travel as one row an issue, dealt by the file; pairs are formed and counted where they arrive.
    """
    return _pairs(_companions(changes))


def cochange(changes: DataFrame, norm: str = "directional", least: int = 2) -> DataFrame:
    """repo, a, b, n, score. directional: n / count(a); symmetric: n / min(count a, count b); raw: n."""
    met = _companions(changes)
    if norm == "raw":
        return _pairs(met).where(F.col("n") >= least).withColumn("score", F.col("n").cast("double"))
    # a file is its own companion once an issue, which counts its issues in the same pass
    n = met.select("repo", "a", F.explode("others").alias("b")).groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumn("ca", F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).over(Window.partitionBy("repo", "a"))).where((F.col("a") != F.col("b")) & (F.col("n") >= least))
    if norm == "symmetric":
        count = met.groupBy("repo", F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("cb"))
        out = out.join(count, ["repo", "b"])
        return out.select("repo", "a", "b", "n", F.round(F.col("n") / F.least("ca", "cb"), 6).alias("score"))
    return out.select("repo", "a", "b", "n", F.round(F.col("n") / F.col("ca"), 6).alias("score"))


#: Hexadecimal digits of the hash by which ``dealt_anew`` splits a repo's edges.
DEALT = 2


def dealt_anew(changes: DataFrame) -> DataFrame:
    """repo, a, b: of a repo's edges (ordered pairs of files changed together) the i-th left end in order gets the right end
    of the i-th edge by the hash of both.

    A file's edges have places that follow each other, so the left ends are a run for each file. Edges are dealt once, by
    the first digits of their hash; the runs are cut where such a part ends, and go to the parts whose places they hold.
    """
    ends = _companions(changes).groupBy("repo", "a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("bs"))
    ends = ends.select("repo", "a", F.array_remove("bs", F.col("a")).alias("bs"))
    pairs = ends.select("repo", "a", F.explode("bs").alias("b")).select("repo", "b", F.md5(F.concat_ws("|", F.lit("edge"), "a", "b")).alias("hash"))
    pairs = pairs.select("repo", F.left("hash", F.lit(DEALT)).alias("part"), F.concat(F.unhex("hash"), F.col("b").cast("binary")).alias("edge"))  # (in order of the hash)
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("repo").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = ends.select("repo", "a", F.size("bs").cast("long").alias("n")).where("n > 0").withColumn("lo", before("a"))
    parts = pairs.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("lo", before("part"))
    # each run meets the part that holds its first place, each part the run that holds its first
    marks = parts.select("repo", "lo", F.lit(0).alias("kind"), F.struct("part", "lo", (F.col("lo") + F.col("n")).alias("hi")).alias("p"), F.lit(None).cast("struct<a:string,lo:bigint,hi:bigint>").alias("r"))
    marks = marks.unionByName(runs.select("repo", "lo", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["p"].dataType).alias("p"), F.struct("a", "lo", (F.col("lo") + F.col("n")).alias("hi")).alias("r")))
    now = Window.partitionBy("repo").orderBy("lo", "kind")
    met = marks.select("repo", F.last("p", ignorenulls=True).over(now).alias("p"), F.last("r", ignorenulls=True).over(now).alias("r")).where("p IS NOT NULL AND r IS NOT NULL")
    met = met.select("repo", "p.part", F.greatest("p.lo", "r.lo").alias("lo"), F.least("p.hi", "r.hi").alias("hi"), "r.a").where("lo < hi")
    left = met.groupBy("repo", "part").agg(F.array_sort(F.collect_list(F.struct("lo", (F.col("hi") - F.col("lo")).cast("int").alias("n"), "a"))).alias("runs"))
    right = pairs.groupBy("repo", "part").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    both = left.join(right, ["repo", "part"]).select("repo", F.flatten(F.transform("runs", lambda x: F.array_repeat(x["a"], x["n"]))).alias("a"), F.transform("edges", lambda x: F.substring(x, 17, 2**31 - 1).cast("string")).alias("b"))
    return both.select("repo", F.inline(F.arrays_zip("a", "b")))


def undirected(edges: DataFrame, self_loops: bool = False) -> DataFrame:
    """repo, a, b both ways, distinct, of repo, src, dst."""
    both = edges.select("repo", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("repo", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    return both if self_loops else both.where("a <> b")


def seeds(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k).select("repo", "issue_id", "path", "rank", "score")


def neighbours(seed: DataFrame, edges: DataFrame, weight) -> DataFrame:
    """repo, issue_id, path, w: the seeds' neighbours over edges (repo, a, b, ...) that aren't seeds; one row an edge.

    They are dealt by issue, as ``best`` needs them.
    """
    out = seed.join(edges.withColumnRenamed("a", "path"), ["repo", "path"]).select("repo", "issue_id", F.col("b").alias("path"), weight.alias("w"))
    return without(out, seed)


def without(found: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of found whose path isn't one of the issue's in held; an issue's held paths are one row, so both meet by issue."""
    held = held.groupBy("repo", "issue_id").agg(F.collect_set("path").alias("_held"))
    return found.join(held, ["repo", "issue_id"], "left").where(~F.coalesce(F.array_contains("_held", F.col("path")), F.lit(False))).drop("_held")


def best(found: DataFrame, how, k: int) -> DataFrame:
    """The k best new files of each issue: how aggregates ``w`` over the links to a file; ties by path."""
    scored = found.groupBy("repo", "issue_id", "path").agg(F.round(how, 6).alias("score"))
    order = Window.partitionBy("repo", "issue_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counterparts(seed: DataFrame, files: DataFrame, weight) -> DataFrame:
    """repo, issue_id, path, w: the existing tests of the seeds, and the sources of seeds that are tests, that aren't seeds.

    A test ``test_x`` has its source beside it or one folder up, ``x_test`` beside it; a source has its test beside it
    or in ``tests/``.
    """
    at = lambda d, name: F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))
    d, b = t.dirname("path"), t.basename("path")
    source, test = F.expr("substring(b, 6)"), F.concat(F.lit("test_"), "b")
    pairs = F.when(F.startswith("b", F.lit("test_")), F.array(at(F.col("d"), source), at(t.dirname("d"), source)))
    pairs = pairs.when(F.endswith("b", F.lit("_test.py")), F.array(at(F.col("d"), F.expr("concat(left(b, length(b) - 8), '.py')"))))
    pairs = pairs.otherwise(F.array(at(F.col("d"), test), at(F.col("d"), F.concat(F.lit("tests/"), test))))
    found = seed.select("repo", "issue_id", d.alias("d"), b.alias("b")).select("repo", "issue_id", F.explode(F.array_distinct(pairs)).alias("path"))
    found = found.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "issue_id", "path", weight.alias("w"))
    return found.join(seed.select("repo", "issue_id", "path"), ["repo", "issue_id", "path"], "left_anti")


def appended(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Sections put after each other, a file kept where it comes first; ranks anew from 1."""
    parts = [s.select("repo", "issue_id", "path", F.lit(i).alias("section"), "rank") for i, s in enumerate((first, *more))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    once = out.repartition("repo", "issue_id").groupBy("repo", "issue_id", "path").agg(F.min(F.struct("section", "rank")).alias("at"))
    order = Window.partitionBy("repo", "issue_id").orderBy("at", "path")
    return once.select("repo", "issue_id", "path", F.col("at.section").alias("section"), F.row_number().over(order).alias("rank"))


def propagate(nodes: DataFrame, edges: DataFrame, alpha: float, steps: int) -> DataFrame:
    """s <- alpha s0 + (1 - alpha) W s over row-normalised edges inside each issue; nodes without edges keep s0.

    nodes: repo, issue_id, path, score; edges: repo, issue_id, a, b, w.
    """
    total = edges.groupBy("repo", "issue_id", "a").agg(F.sum("w").alias("t"))
    rows = edges.join(total, ["repo", "issue_id", "a"]).select("repo", "issue_id", "a", "b", (F.col("w") / F.col("t")).alias("w"))
    now = nodes.select("repo", "issue_id", "path", F.col("score").alias("s0"), F.col("score").alias("s"))
    for _ in range(steps):
        pulled = rows.join(now.select("repo", "issue_id", F.col("path").alias("b"), "s"), ["repo", "issue_id", "b"]).groupBy("repo", "issue_id", F.col("a").alias("path")).agg(F.sum(F.col("w") * F.col("s")).alias("p"))
        now = now.join(pulled, ["repo", "issue_id", "path"], "left").select("repo", "issue_id", "path", "s0", F.when(F.col("p").isNull(), F.col("s0")).otherwise(alpha * F.col("s0") + (1 - alpha) * F.col("p")).alias("s"))
    return now.select("repo", "issue_id", "path", F.round(F.col("s") + 1e-9, 6).alias("score"))
