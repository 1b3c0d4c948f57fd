"""Unified diffs as rows: every line with its file and its numbers on both sides, read within its patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
_LINE = "struct<file: string, sign: string, old: bigint, new: bigint>"


def lines_of(patch: str | Column) -> Column:
    """The lines inside hunks as an array of (file, sign, old, new) in their order; null for a null patch.

    A hunk's header sets both counters; removed lines count on the old side, added ones on the new, all others on both.
    """
    # (how a line begins is looked at first: few lines need a pattern)
    header = lambda x: F.startswith(x, F.lit("@@ -")) & x.rlike(HUNK)
    group = lambda x, i: F.regexp_extract(x, HUNK, i).cast("long")

    def step(s, x):
        named = F.when(F.startswith(x, F.lit("+++ b/")), F.nullif(F.regexp_extract(x, r"^\+\+\+ b/(.+)$", 1), F.lit("")))
        file = F.coalesce(named, s["file"])
        sign = F.when(F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---")), "-").when(F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")), "+").otherwise(" ")
        line = F.struct(file.alias("file"), sign.alias("sign"), s["old"].alias("old"), s["new"].alias("new"))
        inside = F.struct(file.alias("file"), (s["old"] + (sign != "+").cast("long")).alias("old"), (s["new"] + (sign != "-").cast("long")).alias("new"), F.array_append(s["out"], line).alias("out"))
        start = F.struct(file.alias("file"), group(x, 1).alias("old"), group(x, 2).alias("new"), s["out"].alias("out"))
        before = F.struct(file.alias("file"), s["old"].alias("old"), s["new"].alias("new"), s["out"].alias("out"))
        return F.when(header(x), start).when(s["old"].isNotNull(), inside).otherwise(before)

    none = F.lit(None)
    zero = F.struct(none.cast("string").alias("file"), none.cast("long").alias("old"), none.cast("long").alias("new"), F.array().cast(f"array<{_LINE}>").alias("out"))
    return F.aggregate(F.split(patch, "\n"), zero, step, lambda s: s["out"])


def patch_lines(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """keys, file, sign (-, + or space), old, new: the lines inside hunks of every patch (``lines_of``). Nothing is shuffled."""
    # (outer, as Spark would read the patch once more to test that it has lines)
    return patches.select(*keys, F.inline_outer(lines_of(patch))).where("sign IS NOT NULL")
