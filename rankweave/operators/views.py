"""Views of source files for a ranker: functions by indentation, ranked within their file, packed up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The form of a definition, BM25's constants, the places of a view.
DEFINED = r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP, HEAD, CAP = 5, 50, 2000


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


def _once(rows: DataFrame, *kept: str, **more: Column) -> DataFrame:
    """The columns kept, and more by name: as a generator's output, so that each is worked out once a row however often it is used."""
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in more.items())))))


def _with_functions(files: DataFrame, kept: list[str], text: str) -> DataFrame:
    """kept and ``fns``: (start, name, body) of each function of the row's text, found in the row."""

    def mark(x, i):
        return F.struct(i.alias("n"), x.rlike(r"[^ \t\r]").alias("full"), F.length(F.regexp_extract(x, r"^[ \t]*", 0)).alias("indent"), F.regexp_extract(x, DEFINED, 1).alias("name"))

    rows = _once(files, *kept, lines=F.split(text, "\n"))
    rows = _once(rows, *kept, "lines", marks=F.filter(F.transform("lines", mark), lambda m: m["full"]))
    levels = F.array_distinct(F.transform(F.filter("marks", lambda m: m["name"] != ""), lambda m: m["indent"]))
    # a level's lines that are indented no deeper: after a function of the level, the next one ends it
    within = F.transform(levels, lambda level: F.struct(level.alias("level"), F.filter("marks", lambda m: m["indent"] <= level).alias("lines")))

    def spans(w):
        every = F.transform(w["lines"], lambda m, i: F.struct(m["n"].alias("n"), m["name"].alias("name"), m["indent"].alias("indent"), F.get(w["lines"], i + 1)["n"].alias("next")))
        return F.filter(every, lambda m: (m["name"] != "") & (m["indent"] == w["level"]))

    def body(m):
        own = F.array_join(F.slice("lines", m["n"] + 1, F.coalesce(m["next"], F.size("lines")) - m["n"]), "\n")
        return F.struct(m["n"].alias("start"), m["name"].alias("name"), F.regexp_replace(own, r"[ \t\r\n]+\z", "").alias("body"))

    return _once(rows, *kept, fns=F.transform(F.flatten(F.transform(within, spans)), body))


def functions(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, start (line from 0), name, body of every function in a text, nested ones as well.

    A function reaches up to the next line that isn't blank and is indented no deeper than its ``def``; blank lines at its end
    don't belong to it. Lines of strings count like others: a file that doesn't parse has functions too. Each indentation at
    which a file defines something is one pass over its lines, in the file's row. Null texts have no functions.
    """
    return _with_functions(files, keys, text).select(*keys, F.inline("fns"))


def _with_scores(rows: DataFrame, kept: list[str], query: str) -> DataFrame:
    """kept and ``fns`` with ``score``: BM25 of the row's functions against its query, worked out in the row."""
    tokens = F.transform("fns", lambda f: F.concat(words(f["body"]), F.filter(F.split(F.lower(f["name"]), "_"), lambda x: x != "")))
    rows = _once(rows, *kept, "fns", tokens=tokens, asked=F.coalesce(words(F.col(query)), F.array().cast("array<string>")))
    # words of the functions in order, one for each function that has it: a word's first place and its number
    rows = _once(rows, *kept, "fns", "tokens", "asked", all=F.sort_array(F.flatten(F.transform("tokens", F.array_distinct))), total=F.aggregate("tokens", F.lit(0), lambda n, x: n + F.size(x)))
    first = F.filter(F.transform("all", lambda x, i: F.when((i == 0) | (x != F.get("all", i - 1)), i)), lambda i: i.isNotNull())
    rows = _once(rows, *kept, "fns", "tokens", "asked", "all", "total", first=first)

    def raw(i, at):
        df = F.coalesce(F.get("first", at + 1), F.size("all")) - i
        return F.log((F.size("fns") - df + 0.5) / (df + 0.5))

    held = ["fns", "tokens", "asked", "total"]
    rows = _once(rows, *kept, *held, known=F.transform("first", lambda i: F.get("all", i)), raw=F.transform("first", raw))
    rows = _once(rows, *kept, *held, "known", "raw", mean=F.aggregate("raw", F.lit(0.0), lambda n, x: n + x) / F.greatest(F.size("raw"), F.lit(1)))
    place = lambda w: F.get("raw", (F.array_position("known", w) - 1).cast("int"))
    number = lambda of, w: F.size(of) - F.size(F.array_remove(of, w))
    found = F.transform(F.array_intersect("asked", "known"), lambda w: F.struct(w.alias("w"), number(F.col("asked"), w).alias("times"), place(w).alias("raw")))
    wanted = F.transform(found, lambda x: F.struct(x["w"].alias("w"), (x["times"] * F.when(x["raw"] < 0, F.col("mean") * EPSILON).otherwise(x["raw"])).alias("weight")))
    rows = _once(rows, *kept, "fns", "tokens", "total", wanted=wanted)

    def score(own):
        norm = K1 * (1 - B + B * F.size(own) * F.size("fns") / F.col("total"))
        each = F.zip_with("wanted", F.transform("wanted", lambda x: number(own, x["w"])), lambda x, tf: x["weight"] * tf * (K1 + 1) / (tf + norm))
        return F.round(F.aggregate(each, F.lit(0.0), lambda n, x: n + x), 6)

    scored = F.zip_with("fns", "tokens", lambda f, own: F.struct(f["start"].alias("start"), f["name"].alias("name"), f["body"].alias("body"), score(own).alias("score")))
    return _once(rows, *kept, fns=scored)


def ranked_functions(defined: DataFrame, asked: DataFrame, keys: list[str], query: str = "query") -> DataFrame:
    """defined with ``score``: BM25 of each function against its file's query, the file's functions being the collection.

    A word of more than half of the functions weighs EPSILON times the mean weight of the file's words; a word that the query repeats
    counts each time. Functions without a word of the query score 0.
    """
    files = defined.groupBy(*keys).agg(F.collect_list(F.struct("start", "name", "body")).alias("fns"))
    return _with_scores(files.join(asked.select(*keys, query), keys, "left"), keys, query).select(*keys, F.inline("fns"))


def views(files: DataFrame, keys: list[str], text: str = "text", query: str = "query", top: int = TOP, head: int = HEAD, cap: int = CAP) -> DataFrame:
    """``packed`` of ``ranked_functions`` of ``functions``, for files that hold their query: all in a file's own row, so nothing is shuffled."""
    rows = _with_scores(_with_functions(files, [*keys, text, query], text), [*keys, text], query)
    best = F.slice(F.array_sort(F.transform("fns", lambda f: F.struct((-f["score"]).alias("by"), f["start"].alias("start"), f["name"].alias("name"), f["body"].alias("body")))), 1, top)
    rows = _once(rows, *keys, text, parts=F.when(F.size("fns") > 0, F.transform(best, lambda f: F.struct(F.concat(F.lit("# "), f["name"], F.lit("\n"), f["body"]).alias("x")))))
    return _shown(rows, keys, text, head, cap)


def _shown(rows: DataFrame, keys: list[str], text: str, head: int, cap: int) -> DataFrame:
    view = F.coalesce(F.array_join(F.transform("parts", lambda p: p["x"]), "\n\n"), F.array_join(F.slice(F.split(text, "\n"), 1, head), "\n"), F.lit("# (file not available)"))
    kind = F.when(F.col("parts").isNotNull(), "functions").when(F.col(text).isNotNull(), "head").otherwise("none")
    return rows.select(*keys, F.left(view, F.lit(cap)).alias("view"), kind.alias("kind"))


def packed(files: DataFrame, scored: DataFrame, keys: list[str], text: str = "text", top: int = TOP, head: int = HEAD, cap: int = CAP) -> DataFrame:
    """keys, view, kind of every file: its ``top`` best functions under their names (ties: the earlier one), cut to ``cap``
    characters; a file without functions shows its first ``head`` lines (``head``), one without a text (``none``) a note."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "start")
    best = scored.withColumn("i", F.row_number().over(order)).where(F.col("i") <= top)
    parts = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("# "), "name", F.lit("\n"), "body").alias("x")))).alias("parts"))
    return _shown(files.join(parts, keys, "left"), keys, text, head, cap)
