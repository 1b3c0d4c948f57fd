"""Renames by content: removed files are matched to added ones, one to one, by the share of their lines.

No two files meet that don't share a rare line: of a file's lines, rarest first, only so many are joined that the
others together can't reach the asked similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions import text as t
from rankweave.sources.scratch import written

#: Equal files are numbered inside so many hash ranges of their paths, so a group of any size is numbered by several tasks.
RANGES = 64


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``i``, gapless from 1 inside keys, in the order of (crc32 of the path modulo RANGES, path)."""
    rows = rows.withColumn("_range", F.crc32(F.col("path").cast("binary")) % RANGES)
    sizes = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("path"))
    return rows.withColumn("_own", own).join(starts, [*keys, "_range"]).withColumn("i", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def _equal(files: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, old, new: the i-th removed with the i-th added file of equal keys."""
    placed = _placed(files, [*keys, "side"])
    old = placed.where("side = 'removed'").select(*keys, "i", F.col("path").alias("old"))
    return old.join(placed.where("side = 'added'").select(*keys, "i", F.col("path").alias("new")), [*keys, "i"]).select(*by, "old", "new")


def _without(files: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    taken = pairs.select(*by, F.explode(F.array(F.struct(F.lit("removed").alias("side"), F.col("old").alias("path")), F.struct(F.lit("added").alias("side"), F.col("new").alias("path")))).alias("x")).select(*by, "x.*")
    return files.join(taken, [*by, "side", "path"], "left_anti")


def similar(files: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, old, new, similarity of all pairs that share at least ``least`` percent of the larger one's bytes, counted by lines.

    A line weighs its bytes and one more; repeated lines count as often as both files have them.
    """
    file = [*by, "side", "path"]
    lines = files.select(*file, F.explode(F.split("text", "\n")).alias("line"))
    per = written(lines.groupBy(*file, F.md5(F.col("line").cast("binary")).alias("line")).agg(F.sum(F.octet_length("line") + 1).cast("long").alias("w")), "lines")
    rarity = per.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy(*file)
    rest = F.sum("w").over(own.orderBy("df", "line").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prefix = per.join(rarity, [*by, "line"]).withColumn("size", F.sum("w").over(own)).withColumn("rest", rest).where(F.col("rest") * 100 >= F.col("size") * least)
    side = lambda name, new: prefix.where(F.col("side") == name).select(*by, "line", F.col("path").alias(new), F.col("size").alias(f"{new}_size"))
    larger = F.greatest("old_size", "new_size")
    pairs = side("removed", "old").join(side("added", "new"), [*by, "line"]).where(F.least("old_size", "new_size") * 100 >= larger * least).select(*by, "old", "new", larger.alias("size")).distinct()
    weights = lambda name, new: per.where(F.col("side") == name).select(*by, F.col("path").alias(new), "line", F.col("w").alias(f"{new}_w"))
    shared = pairs.join(weights("removed", "old"), [*by, "old"]).join(weights("added", "new"), [*by, "new", "line"]).groupBy(*by, "old", "new").agg(F.sum(F.least("old_w", "new_w")).alias("shared"), F.first("size").alias("size"))
    return shared.select(*by, "old", "new", F.floor(F.col("shared") * 100 / F.col("size")).cast("int").alias("similarity")).where(F.col("similarity") >= least)


def matched(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges that a greedy choice takes: most similar first, then equal file names, then old and new path; a file once.

    An edge that is the best of both its files is taken, and edges of taken files go, until none is left. That takes the
    same edges as one walk over all of them in order. A round costs two aggregates; there are as many as the longest chain
    of files each of which prefers the next one.
    """
    order = F.struct(-F.col("similarity"), (t.basename("old") != t.basename("new")).cast("int"), "old", "new")
    left = written(edges.withColumn("o", order), "edges")
    found = []
    while not left.isEmpty():
        best = lambda c: left.groupBy(*by, c).agg(F.min("o").alias("o"))  # noqa: E731, B023
        taken = written(left.join(best("old"), [*by, "old", "o"]).join(best("new"), [*by, "new", "o"]).select(*by, "old", "new", "similarity"), "matched")
        found.append(taken)
        left = written(left.join(taken.select(*by, "old"), [*by, "old"], "left_anti").join(taken.select(*by, "new"), [*by, "new"], "left_anti"), "edges")
    out = edges.select(*by, "old", "new", "similarity").limit(0) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def renames(changes: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """by, old, new, similarity (percent) of the renames in each change set.

    changes: by, side (``removed`` or ``added``), path, text; a path is once on a side (of repeated rows one counts). Equal files are paired first, those of
    equal file name before others; then the rest by shared lines. Empty and null texts are nobody's origin. A null in ``by`` or path: no rename.
    """
    rows = changes.where("side IN ('removed', 'added') AND path IS NOT NULL AND text <> ''").dropna(subset=by).select(*by, "side", "path", "text")
    files = written(rows.groupBy(*by, "side", "path").agg(F.min("text").alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("name", t.basename("path")), "files")
    bare = files.drop("text")
    named = written(_equal(bare, [*by, "digest", "name"], by), "equal")
    equal = written(named.unionByName(_equal(_without(bare, named, by), [*by, "digest"], by)), "equal")
    near = matched(similar(_without(files, equal, by), by, least), by)
    return equal.withColumn("similarity", F.lit(100)).unionByName(near)
