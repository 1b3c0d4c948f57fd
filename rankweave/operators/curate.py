"""Negative mining, cleaning, splits, audits and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.sources.scratch import written

KEY = ("repo", "issue_id")
#: Issues that meet a copy of their repo's files, on average, and copies at most.
ISSUES, COPIES = 20_000, 16


def quota(candidates: DataFrame, quotas: dict[str, int], seed: str = "42") -> DataFrame:
    """Up to a quota of each ``source``'s candidates, in hash order; a path counts for the first source that has it."""
    order = {s: i for i, s in enumerate(quotas)}
    place = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("source"))
    first = candidates.where(F.col("source").isin(*quotas)).groupBy(*KEY, "path").agg(F.min_by("source", place).alias("source"))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("source"))
    rank = F.row_number().over(Window.partitionBy(*KEY, "source").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "issue_id", "path")), "path"))
    return first.withColumn("n", rank).where(F.col("n") <= most).select(*KEY, "path", "source")


def reasons(*cases: tuple[str, Column]) -> Column:
    """The first reason that holds, else null."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(cases):
        out = F.when(cond, name).otherwise(out)
    return out


def heldout_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The k groups with most rows (one row a group is all that is ordered)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)


def digest(rows: DataFrame, *keys: str) -> DataFrame:
    """One SHA-256 of each group: row hashes, sorted, hashed again, so partitioning and order don't show."""
    each = rows.select(*keys, F.sha2(F.concat_ws("|", *(c for c in rows.columns)), 256).alias("h"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def _suffixes(path: str) -> Column:
    """(k, the last k components) for every k."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/").alias("suffix")))


def resolve_aliases(old: DataFrame, current: DataFrame, most: float = 0.4) -> DataFrame:
    """repo, old, path: where a file of old(repo, old) is now among current(repo, path, readable); null if nowhere.

    The current file with the longest run of trailing components in common, of those the shortest, then the first. If
    that one can't be read, the file of the same name at the least edit distance, if it can be read and the distance is
    under ``most`` of the old path's length. Suffixes meet by equality and only the best file of a suffix is joined, so
    a name that thousands of files have costs no pairs; files are compared one by one only for unreadable matches.
    """
    old = old.distinct()
    ends = current.select("repo", "path", "readable", F.explode(_suffixes("path")).alias("e"))
    ends = ends.groupBy("repo", F.col("e.suffix").alias("suffix")).agg(F.min(F.struct(F.length("path").alias("n"), "path", "readable")).alias("at"))
    asked = old.select("repo", "old", F.explode(_suffixes("old")).alias("e")).select("repo", "old", F.col("e.k").alias("k"), F.col("e.suffix").alias("suffix"))
    met = asked.join(ends, ["repo", "suffix"]).groupBy("repo", "old").agg(F.max_by("at", "k").alias("at"))
    name = lambda c: F.substring_index(c, "/", -1).alias("name")
    lost = met.where("NOT at.readable").select("repo", "old", name("old"))
    near = lost.join(current.select("repo", "path", "readable", name("path")), ["repo", "name"])
    near = near.groupBy("repo", "old").agg(F.min(F.struct(F.levenshtein("old", "path").alias("far"), "path", "readable")).alias("near"))
    found = F.when(F.col("at.readable"), F.col("at.path")).when(F.col("near.readable") & (F.col("near.far") < most * F.length("old")), F.col("near.path"))
    return old.join(met, ["repo", "old"], "left").join(near, ["repo", "old"], "left").select("repo", "old", found.alias("path"))


def sampled_pairs(edges: DataFrame, files: DataFrame, ratio: int, draws: int) -> DataFrame:
    """repo, a, b, y: the edges (a < b) as 1 and up to ``ratio`` times as many pairs of the repo's files without one as 0.

    Every edge draws ``draws`` pairs of places in its repo's sorted files from md5, so candidates grow with the edges and
    not with the squared number of files; repeated pairs, edges and pairs of one file drop out.
    """
    places = files.select("repo", "path").distinct().withColumn("i", F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1)
    number = places.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    place = lambda end: F.conv(F.left(F.md5(F.concat_ws("|", "repo", "a", "b", F.col("k").cast("string"), F.lit(end))), F.lit(6)), 16, 10).cast("long") % F.col("n")
    drawn = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).join(number, "repo").select("repo", place("x").alias("i"), place("y").alias("j")).where("i <> j")
    first = drawn.join(places.withColumnRenamed("path", "p"), ["repo", "i"]).join(places.select("repo", F.col("i").alias("j"), F.col("path").alias("q")), ["repo", "j"])
    pairs = first.select("repo", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(edges, ["repo", "a", "b"], "left_anti")
    order = Window.partitionBy("repo").orderBy(F.md5(F.concat_ws("|", "repo", "a", "b")), "a", "b")
    most = edges.groupBy("repo").agg((F.count(F.lit(1)) * ratio).alias("most"))
    none = pairs.withColumn("r", F.row_number().over(order)).join(most, "repo").where("r <= most")
    return edges.select("repo", "a", "b", F.lit(1).alias("y")).unionByName(none.select("repo", "a", "b", F.lit(0).alias("y")))


def first_by_hash(want: DataFrame, every: DataFrame, salt: str, by: tuple[str, ...] = ("repo",), spare: int = 12) -> DataFrame:
    """repo, issue_id, path, at (from 1): of the files that share ``by`` with an issue the n first by md5 of salt, issue and path.

    want: repo, issue_id, n, held (an array: files that don't count), by, and ``issue_id`` may have several rows, a group each;
    every: by, path. Each issue's hash of each file is looked at where the two meet, and most files are told by it not to be
    among the first: it lies above a bound that some n + spare stay below. No pair is shuffled. Issues for which too few
    stay below meet all their files once more.
    """
    every, want = written(every.select(*by, "path"), "files"), written(want.select("repo", "issue_id", "n", "held", *(c for c in by if c != "repo")), "want")
    copies = max(1, min(COPIES, want.count() // ISSUES))
    size = every.groupBy(*by).agg(F.count(F.lit(1)).alias("all"))
    asked = want.join(size, list(by)).withColumn("part", F.pmod(F.xxhash64("issue_id"), F.lit(copies)).cast("int"))
    pool = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    share = F.least(F.lit(1.0), (F.col("n") + spare) / F.col("all"))
    bound = F.lower(F.lpad(F.hex(F.floor(share * F.lit(0xFFFFFFFF)).cast("long")), 8, "0"))
    order = Window.partitionBy(*by, "part", "issue_id").orderBy("h", "path")

    def best(asked, *below):
        met = asked.join(pool, [*by, "part"]).withColumn("h", F.md5(F.concat_ws("|", F.lit(salt), "issue_id", "path")))
        for cond in (*below, ~F.array_contains("held", F.col("path"))):
            met = met.where(cond)
        return met.withColumn("at", F.row_number().over(order)).where("at <= n").select(*dict.fromkeys(["repo", *by]), "issue_id", "path", "h", "at")

    found = written(best(asked.withColumn("bound", bound), F.left("h", F.lit(8)) <= F.col("bound")), "found")
    enough = found.groupBy(*by, "issue_id").agg(F.count(F.lit(1)).alias("m"))
    short = written(asked.join(enough, [*by, "issue_id"], "left").where((F.coalesce("m", F.lit(0)) < F.col("n")) & (F.col("n") + spare < F.col("all"))).select(asked.columns), "short")
    if short.limit(1).count():
        found = found.join(short.select(*by, "issue_id"), [*by, "issue_id"], "left_anti").unionByName(best(short))
    return found
