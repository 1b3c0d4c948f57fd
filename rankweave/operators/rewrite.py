"""Rewriting of sources, as expressions: local paths and modules get aliases, functions get hashed names.

A text is cut into runs by one pattern, the runs are transformed, and the runs are joined again, so nothing is lost
between them and no text meets a pattern that was built from another row. Texts stay in the JVM.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import text as t

from .perturb import hash_path, sha

# The shapes of paths, modules, import lines and definitions, and the folders that only wrap a package.
FILE = r"^[A-Za-z_][A-Za-z0-9_-]*(?:/[A-Za-z0-9_][A-Za-z0-9_.-]*)+\.py$"
FOLDER = r"^[A-Za-z_][A-Za-z0-9_-]*(?:/[A-Za-z0-9_][A-Za-z0-9_.-]*)+/$"
DOTTED = r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$"
FROM = r"^(\s*from\s+)([A-Za-z_][A-Za-z0-9_\.]*)(\s+import\b[^\n]*)$"
IMPORT = r"^(\s*import\s+)([^\n]+?)(\r?)$"
IMPORTED = r"^\s*([A-Za-z_][A-Za-z0-9_\.]*)(\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?\s*$"
DEF = r"^(\s*def\s+)([A-Za-z_][A-Za-z_0-9]*)(\s*\([^\n]*)$"
METHOD = r"^(\s*class\s+)([A-Za-z_][A-Za-z_0-9]*)(\s*[:(][^\n]*?\bdef\s+)([A-Za-z_][A-Za-z_0-9]*)(\s*\([^\n]*)$"
WRAPPERS = ["src", "lib", "python", "py", "package", "packages"]
#: Module names of the interpreter's own library are never local.
STDLIB = sorted(sys.stdlib_module_names)
#: Runs that may be a path or module, and what lies between.
RUNS = r"[A-Za-z0-9_./-]+|[^A-Za-z0-9_./-]+"
#: Strings (a quote ends one if an even number of backslashes is in front), comments, and the code between.
PIECES = r"""(?s:\"{3}.*?(?<!\\)(?:\\\\)*+\"{3}|'{3}.*?(?<!\\)(?:\\\\)*+'{3})|"[^\n]*?(?<!\\)(?:\\\\)*+"|'[^\n]*?(?<!\\)(?:\\\\)*+'|#[^\n]*|[^"'#]+|["']"""


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def repo_roots(files: DataFrame) -> DataFrame:
    """repo, roots: first folders of the repo's files (behind a wrapper folder the second part too) and forms of its name."""
    parts = F.filter(F.split(F.lower("path"), "/"), lambda x: x != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    own = F.when(first.isin(WRAPPERS) & (F.size(parts) > 1), F.array(first, second)).otherwise(F.array(first))
    name = F.lower(F.regexp_replace("repo", r"^.*?__", ""))
    names = F.filter(F.array(name, F.replace(name, F.lit("-"), F.lit("_")), F.replace(name, F.lit("-"), F.lit(""))), lambda x: (x != "") & ~x.isin(STDLIB))
    rows = files.where(F.size(parts) > 0).select("repo", F.explode(own).alias("root")).distinct()
    return rows.unionByName(files.select("repo").distinct().select("repo", F.explode(names).alias("root"))).groupBy("repo").agg(F.array_sort(F.collect_set("root")).alias("roots"))


def _local(root: Column, roots: Column) -> Column:
    return F.array_contains(roots, F.lower(root)) & ~F.lower(root).isin(STDLIB)


def alias_path(path: Column) -> Column:
    """Folders and .py leaf hashed without regard to case; a closing slash stays."""
    return F.concat(hash_path(F.lower(path)), F.when(path.endswith("/"), "/").otherwise(""))


def alias_module(dotted: Column) -> Column:
    """The alias that the path of the module has, with dots; one name alone counts as a folder."""
    parts = F.filter(F.split(F.lower(dotted), r"\."), lambda x: x != "")
    last = F.size(parts) - 1
    one = lambda x, i: F.when((i == last) & (last > 0), F.concat(F.lit("m_"), sha(F.concat(x, F.lit(".py")), 16))).otherwise(F.concat(F.lit("d_"), sha(x, 16)))
    return F.array_join(F.transform(parts, one), ".")


def clean_words(text: str | Column, roots: str | Column) -> Column:
    """Text in which paths and dotted modules below a local root have aliases.

    A run of letters, digits and ``_./-`` is rewritten if it is a path or module as a whole, so ``x/y.py`` in a
    URL or at the end of a sentence (with its full stop) stays. Null text or roots: null.
    """

    def one(run):
        path = run.rlike(FILE) | run.rlike(FOLDER)
        return F.when(path & _local(F.split_part(run, F.lit("/"), F.lit(1)), roots), alias_path(run)).when(run.rlike(DOTTED) & _local(F.split_part(run, F.lit("."), F.lit(1)), roots), alias_module(run)).otherwise(run)

    text, roots = t._col(text), t._col(roots)
    return F.array_join(F.transform(_all(text, RUNS), one), "")


def clean_imports(text: str | Column, roots: str | Column) -> Column:
    """Text in which import lines name local modules by alias; other lines, and all line ends, stay. Null: null."""
    text, roots = t._col(text), t._col(roots)
    root = lambda module: F.split_part(module, F.lit("."), F.lit(1))

    def imported(piece):
        module = F.regexp_extract(piece, IMPORTED, 1)
        local = (module != "") & _local(root(module), roots)
        return F.when(local, F.concat(F.when(piece.startswith(" "), " ").otherwise(""), alias_module(module), F.regexp_extract(piece, IMPORTED, 2))).otherwise(piece)

    def line(x):
        module = F.regexp_extract(x, FROM, 2)
        whole = F.concat(F.regexp_extract(x, FROM, 1), alias_module(module), F.regexp_extract(x, FROM, 3))
        several = F.concat(F.regexp_extract(x, IMPORT, 1), F.array_join(F.transform(F.split(F.regexp_extract(x, IMPORT, 2), ","), imported), ","), F.regexp_extract(x, IMPORT, 3))
        return F.when(x.rlike(FROM), F.when(_local(root(module), roots), whole).otherwise(x)).when(x.rlike(IMPORT), several).otherwise(x)

    return F.array_join(F.transform(_lines(text), line), "\n")


def clean_source(text: str | Column, roots: str | Column) -> Column:
    """Source with aliases in import lines, comments and strings.

    A formatted string counts as a string in whole, and a quote that nothing closes is code: a broken source is cleaned as
    far as it can be read.
    """
    roots = t._col(roots)
    one = lambda x: F.when(x.rlike(r"""^(?s:["'#].)"""), clean_words(x, roots)).otherwise(x)
    return F.array_join(F.transform(_all(clean_imports(text, roots), PIECES), one), "")


# ---- functions by hashed names ----------------------------------------------------------------------------


def _names(tail: Column) -> Column:
    return F.split(tail, "/")


def function_tail(item: str | Column) -> Column:
    """What follows the first ``.py/`` of an id; empty without one."""
    return F.regexp_extract(t._col(item), r"^(?s:.*?)\.py/((?s:.*))$", 1)


def hash_tail(tail: Column) -> Column:
    """f_ of a function; C_ of a class and m_ of its method, bound to the class; deeper parts bound to all in front."""
    parts = _names(tail)
    n = F.size(parts)
    deep = lambda x, i: F.concat(F.when(i < n - 1, "X_").otherwise("m_"), sha(F.concat(F.when(i < n - 1, "XCLASS::").otherwise("XMETHOD::"), F.array_join(F.slice(parts, 1, i + 1), "::")), 16))
    method = F.concat(F.lit("C_"), sha(F.concat(F.lit("CLASS::"), parts[0]), 16), F.lit("/m_"), sha(F.concat(F.lit("METHOD::"), F.array_join(parts, "::")), 16))
    return F.when(n == 1, F.concat(F.lit("f_"), sha(F.concat(F.lit("FUNC::"), tail), 16))).when(n == 2, method).otherwise(F.array_join(F.transform(parts, deep), "/"))


def swapped_id(item: str | Column) -> Column:
    """The id with its function part hashed; an id without one stays. Null: null."""
    item = t._col(item)
    tail = function_tail(item)
    return F.when(tail == "", item).otherwise(F.concat(F.left(item, F.length(item) - F.length(tail)), hash_tail(tail)))


def swap_functions(rows: DataFrame, item: str = "item", body: str = "body") -> DataFrame:
    """rows with ``new_id``, ``new_body``, ``status`` and ``audited``.

    The first line that defines the id's function is rewritten. ``main``: ``def name(`` for a function, or for a method a first line
    ``class Name: ... def name(``; ``fallback``: a method without that class line, whose ``def`` alone is rewritten;
    ``miss``: no such line; ``noop``: the id names no function. Definitions that come
    before or inside with another name stay. ``audited``: the rewritten text holds every hashed name that the
    status promises (null for miss and noop). A body that repeats the id as its first line has the new id there. Null bodies are empty.
    """
    c = {n: F.col(f"_{n}") for n in ("tail", "hashed", "lines", "skip", "at", "wrapped")}
    text = F.coalesce(F.col(body), F.lit(""))
    lines = _lines(text)
    skip = (lines[0] == F.col(item)).cast("int")
    out = rows.withColumns({"_tail": F.coalesce(function_tail(item), F.lit("")), "new_id": swapped_id(item), "_lines": lines, "_skip": F.coalesce(skip, F.lit(0))})
    out = out.withColumn("_hashed", F.when(c["tail"] != "", _names(hash_tail(c["tail"]))))
    parts, leaf = _names(c["tail"]), F.element_at(_names(c["tail"]), -1)
    own = F.slice(c["lines"], c["skip"] + 1, F.size(c["lines"]))
    filled = F.array_position(F.transform(own, lambda x: x.rlike(r"\S")), True)
    first = F.coalesce(F.try_element_at(own, F.nullif(filled, F.lit(0)).cast("int")), F.lit(""))
    wrapped = (F.size(parts) == 2) & (F.regexp_extract(first, METHOD, 2) == parts[0]) & (F.regexp_extract(first, METHOD, 4) == leaf)
    defined = F.array_position(F.transform(own, lambda x: F.regexp_extract(x, DEF, 2)), leaf)
    out = out.withColumns({"_wrapped": wrapped, "_at": F.when(c["tail"] == "", 0).when(wrapped, filled).otherwise(defined) + c["skip"]})
    status = F.when(c["tail"] == "", "noop").when(c["at"] == c["skip"], "miss").when((F.size(parts) == 2) & ~c["wrapped"], "fallback").otherwise("main")
    new = F.element_at(c["hashed"], -1)
    as_method = lambda x: F.concat(F.regexp_extract(x, METHOD, 1), c["hashed"][0], F.regexp_extract(x, METHOD, 3), new, F.regexp_extract(x, METHOD, 5))
    as_def = lambda x: F.concat(F.regexp_extract(x, DEF, 1), new, F.regexp_extract(x, DEF, 3))
    line = lambda x, i: F.when((i == 0) & (c["skip"] == 1), F.col("new_id")).when((c["at"] > c["skip"]) & (i == c["at"] - 1), F.when(c["wrapped"], as_method(x)).otherwise(as_def(x))).otherwise(x)
    out = out.withColumns({"status": status, "new_body": F.array_join(F.transform(c["lines"], line), "\n")})
    # the audit reads the finished text, and of a fallback only the method's name is due
    due = F.when(F.col("status") == "fallback", F.array(new)).when(F.size(parts) == 2, c["hashed"]).otherwise(F.array(new))
    written = F.array_join(F.slice(_lines(F.col("new_body")), c["skip"] + 1, F.size(c["lines"])), "\n")
    audited = F.when(F.col("status").isin("main", "fallback"), F.forall(due, lambda x: F.contains(written, x)))
    return out.withColumn("audited", audited).drop(*(f"_{n}" for n in c))
