"""Queries of renames by content, over change sets made of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import renames as r
from rankweave.sources.fixtures import load

from .base import plain


def _versions(s, d):
    """repo, commit, side, path, text: documents that were moved, moved and edited, removed, added, or moved and cut by half, a sentence a line."""
    i = F.col("doc_id")
    kind, text = i % 7, F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    docs = load(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("repo"), (i % 5).alias("commit"), i.alias("doc_id"), kind.alias("kind"), text.alias("text"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".py"))
    path = lambda folder, n: F.concat(F.lit(folder), (F.col("doc_id") % n).cast("string"), F.lit("/"), name)
    removed = docs.where("kind <> 5").select("repo", "commit", F.lit("removed").alias("side"), path("d", 10).alias("path"), "text")
    edited = F.when(F.col("kind").isin(2, 3), F.concat(F.lit("# edited\n"), "text")).when(F.col("kind") == 6, F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    return removed.unionByName(docs.where("kind <> 4").select("repo", "commit", F.lit("added").alias("side"), path("e", 3).alias("path"), edited.alias("text")))


@plain("renames_mine")
def _mined(s, d):
    """Renames from .py to .py of at least 50 percent, with their similarity."""
    return r.renames(_versions(s, d), ["repo", "commit"]).where("old LIKE '%.py' AND new LIKE '%.py'")


@plain("scan_git_renames")
def _scanned(s, d):
    """Other names of every file that was ever renamed, in both directions, where one of both names ends in .py."""
    found = r.renames(_versions(s, d), ["repo", "commit"]).where("old LIKE '%.py' OR new LIKE '%.py'")
    return found.select("repo", F.explode(F.array(F.struct(F.col("old").alias("path"), F.col("new").alias("other")), F.struct(F.col("new").alias("path"), F.col("old").alias("other")))).alias("x")).select("repo", "x.*").distinct()
