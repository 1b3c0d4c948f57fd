"""Queries of rewritten sources: made-up modules around the whole texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import text as t
from rankweave.operators import rewrite as w
from rankweave.sources.fixtures import files, load, parts

from .base import query

#: Modules name one of the first files; all tables have so many.
NAMED = 200


def _modules(s, d):
    """doc_id, repo, path, module, text (null as empty): a document, and the file that its module is about."""
    docs = load(s, d, "documents").select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 25).cast("string")).alias("repo"), (F.col("doc_id") % NAMED).alias("p_partkey"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(parts(s, d).where(F.col("p_partkey") < NAMED), "p_partkey").select("doc_id", "repo", "path", F.translate(t.strip_py("path"), "/", ".").alias("module"), "text")


def _imports(s, d):
    """A module per document with import lines of three kinds, and its repo's roots."""
    m = F.col("module")
    code = F.concat(F.lit("from "), m, F.lit(" import load\nimport os, "), m, F.lit(" as m , json\n  import numpy.core\nx = "), m, F.lit(".x\n"), "text")
    roots = w.repo_roots(files(s, d))
    return _modules(s, d).join(roots, "repo", "left").select("doc_id", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"), "path", "module", "text", code.alias("code"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _alias(x: str, sep: str, n: str) -> str:
    """The aliases of the parts of x, which are also counted; n keeps the names of nested lambdas apart."""
    own = f"list_filter(string_split(lower({x}), '{sep}'), lambda p{n}: p{n} <> '')"
    last = f"i{n} = len(list_filter(string_split(lower({x}), '{sep}'), lambda r{n}: r{n} <> ''))"
    leaf = f"{last} AND q{n} LIKE '%.py' THEN 'm_' || left(sha256(q{n}), 16) || '.py'" if sep == "/" else f"{last} AND i{n} > 1 THEN 'm_' || left(sha256(q{n} || '.py'), 16)"
    return f"array_to_string(list_transform({own}, lambda q{n}, i{n}: CASE WHEN {leaf} ELSE 'd_' || left(sha256(q{n}), 16) END), '{sep}')"


def _words(text: str) -> str:
    local = "list_contains(roots, lower(split_part(x, '{}', 1)))"
    return f"""array_to_string(list_transform(regexp_extract_all({text}, {_sql(w.RUNS)}), lambda x: CASE
        WHEN (regexp_matches(x, {_sql(w.FILE)}) OR regexp_matches(x, {_sql(w.FOLDER)})) AND {local.format('/')} THEN {_alias('x', '/', 'a')} || CASE WHEN x LIKE '%/' THEN '/' ELSE '' END
        WHEN regexp_matches(x, {_sql(w.DOTTED)}) AND {local.format('.')} THEN {_alias('x', '.', 'b')} ELSE x END), '')"""


def _import_lines(text: str) -> str:
    module, piece = f"regexp_extract(l, {_sql(w.FROM)}, 2)", f"regexp_extract(y, {_sql(w.IMPORTED)}, 1)"
    local = "list_contains(roots, lower(split_part({}, '.', 1)))"
    return f"""array_to_string(list_transform(string_split({text}, chr(10)), lambda l: CASE
        WHEN regexp_matches(l, {_sql(w.FROM)}) AND {local.format(module)} THEN regexp_extract(l, {_sql(w.FROM)}, 1) || {_alias(module, '.', 'c')} || regexp_extract(l, {_sql(w.FROM)}, 3)
        WHEN regexp_matches(l, {_sql(w.IMPORT)}) THEN regexp_extract(l, {_sql(w.IMPORT)}, 1) || array_to_string(list_transform(string_split(regexp_extract(l, {_sql(w.IMPORT)}, 2), ','), lambda y: CASE
            WHEN {piece} <> '' AND {local.format(piece)} THEN CASE WHEN y LIKE ' %' THEN ' ' ELSE '' END || {_alias(piece, '.', 'd')} || regexp_extract(y, {_sql(w.IMPORTED)}, 2) ELSE y END), ',') || regexp_extract(l, {_sql(w.IMPORT)}, 3)
        ELSE l END), chr(10))"""


_SQL_PIECES = r"""(?s:"{3}(?:[^\\]|\\.)*?"{3}|'{3}(?:[^\\]|\\.)*?'{3})|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|#[^\n]*|[^"'#]+|["']"""
_STD = ", ".join(f"'{x}'" for x in w.STDLIB)
_MODULES = f"""+roots AS MATERIALIZED (SELECT repo, list(DISTINCT root) AS roots FROM (SELECT repo, lower(split_part(path, '/', 1)) AS root FROM files UNION ALL SELECT repo, repo FROM files) WHERE root NOT IN ({_STD}) GROUP BY repo),
modules AS (SELECT doc_id, d.repo, coalesce(roots, []) AS roots, path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module, text
            FROM (SELECT doc_id, 'r' || doc_id % 25 AS repo, doc_id % {NAMED} AS p_partkey, coalesce(text, '') AS text FROM documents) d JOIN parts USING (p_partkey) LEFT JOIN roots USING (repo)),
code AS (SELECT *, 'from ' || module || ' import load' || chr(10) || 'import os, ' || module || ' as m , json' || chr(10) || '  import numpy.core' || chr(10) || 'x = ' || module || '.x' || chr(10) || text AS code FROM modules)"""


@query("cleanlite_import", f"{_MODULES} SELECT doc_id, {_import_lines('code')} AS text FROM code")
def _import(s, d):
    """Import lines name local modules by alias; everything else stays as it is."""
    return _imports(s, d).select("doc_id", w.clean_imports("code", "roots").alias("text"))


@query(
    "cleanlite_text",
    f"""{_MODULES},
cleaned AS MATERIALIZED (SELECT doc_id, roots, {_import_lines("code || '# see ' || path || ', https://' || path || ' or ' || regexp_extract(path, '^(.*)/[^/]*$', 1) || '/ (' || module || ').' || chr(10) || 's = ''' || module || ''' + t(' || module || ')' || chr(10) || repeat(chr(34), 3) || text || ' ' || path || chr(10) || repeat(chr(34), 3) || chr(10)")} AS code FROM code)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(code, {_sql(_SQL_PIECES)}), lambda z: CASE WHEN regexp_matches(z, '^(?s:["''#].)') THEN {_words('z')} ELSE z END), '') AS text FROM cleaned""",
)
def _text(s, d):
    """Local paths and modules have aliases in import lines, comments and strings, but not in code and URLs."""
    path, m, quotes = F.col("path"), F.col("module"), F.lit('"""')
    code = F.concat(
        "code", F.lit("# see "), path, F.lit(", https://"), path, F.lit(" or "), t.dirname("path"), F.lit("/ ("), m, F.lit(").\ns = '"), m, F.lit("' + t("), m, F.lit(")\n"), quotes, "text", F.lit(" "), path, F.lit("\n"), quotes, F.lit("\n"),
    )
    return _imports(s, d).select("doc_id", w.clean_source(code, "roots").alias("text"))


# ---- functions by hashed names ----------------------------------------------------------------------------


def _functions(s, d):
    """doc_id, item, body: a function around each document, in six kinds: plain, method with and without its class, deep, missing, and no function."""
    kind = F.col("doc_id") % 6
    name = F.concat(F.lit("get_"), F.split_part("module", F.lit("."), F.lit(2)))
    owner = F.split_part("module", F.lit("."), F.lit(3))
    tail = F.when(kind == 5, "").when(kind.isin(1, 2), F.concat(F.lit("/"), owner, F.lit("/"), name)).when(kind == 3, F.concat(F.lit("/"), owner, F.lit("/Inner/"), name)).otherwise(F.concat(F.lit("/"), name))
    head = F.when(kind == 1, F.concat(F.lit("class "), owner, F.lit(":    def "), name, F.lit("(self):"))).when(kind == 4, "def other():").otherwise(F.concat(F.lit("def first(x): pass\n  def "), name, F.lit(" (a, b):")))
    item = F.concat("path", tail)
    body = F.concat(F.when(F.col("doc_id") % 4 == 0, F.concat(item, F.lit("\n"))).otherwise(""), head, F.lit("\n"), F.col("text"), F.lit("\n  def "), name, F.lit("(): pass"))
    return _modules(s, d).select("doc_id", item.alias("item"), F.when(kind == 4, F.replace(body, F.concat(F.lit("def "), name), F.lit("def x"))).otherwise(body).alias("body"))


_FUNCTIONS = f"""{_MODULES},
kinds AS (SELECT doc_id, path, text, doc_id % 6 AS kind, 'get_' || split_part(module, '.', 2) AS name, split_part(module, '.', 3) AS owner FROM modules),
tails AS (SELECT *, CASE WHEN kind = 5 THEN '' WHEN kind IN (1, 2) THEN owner || '/' || name WHEN kind = 3 THEN owner || '/Inner/' || name ELSE name END AS tail FROM kinds),
made AS (SELECT *, path || CASE WHEN tail = '' THEN '' ELSE '/' || tail END AS item, CASE WHEN kind = 1 THEN 'class ' || owner || ':    def ' || name || '(self):' WHEN kind = 4 THEN 'def other():' ELSE 'def first(x): pass' || chr(10) || '  def ' || name || ' (a, b):' END AS head,
         chr(10) || text || chr(10) || '  def ' || CASE WHEN kind = 4 THEN 'x' ELSE name END || '(): pass' AS foot,
         left(sha256('XCLASS::' || owner), 16) AS hx, left(sha256('XCLASS::' || owner || '::Inner'), 16) AS hi, left(sha256('XMETHOD::' || owner || '::Inner::' || name), 16) AS hd,
         left(sha256('CLASS::' || owner), 16) AS hc, left(sha256('METHOD::' || owner || '::' || name), 16) AS hm, left(sha256('FUNC::' || name), 16) AS hf FROM tails),
swapped AS (SELECT *, path || CASE WHEN kind = 5 THEN '' WHEN kind IN (1, 2) THEN '/C_' || hc || '/m_' || hm WHEN kind = 3 THEN '/X_' || hx || '/X_' || hi || '/m_' || hd ELSE '/f_' || hf END AS new_id FROM made)"""


@query("funcswap_id", f"{_FUNCTIONS} SELECT doc_id, new_id FROM swapped")
def _swapped_id(s, d):
    return _functions(s, d).select("doc_id", w.swapped_id("item").alias("new_id"))


@query(
    "funcswap_body",
    f"""{_FUNCTIONS} SELECT doc_id, new_id, CASE WHEN doc_id % 4 = 0 THEN new_id || chr(10) ELSE '' END || CASE WHEN kind IN (4, 5) THEN head WHEN kind = 1 THEN 'class C_' || hc || ':    def m_' || hm || '(self):'
      ELSE 'def first(x): pass' || chr(10) || '  def ' || CASE kind WHEN 0 THEN 'f_' || hf WHEN 2 THEN 'm_' || hm ELSE 'm_' || hd END || ' (a, b):' END || foot AS new_body,
      CASE WHEN kind IN (0, 1, 3) THEN 'main' WHEN kind = 2 THEN 'fallback' WHEN kind = 4 THEN 'miss' ELSE 'noop' END AS status, kind < 4 AS audited, n AS same_id
    FROM swapped JOIN (SELECT new_id, count(*) AS n FROM swapped GROUP BY new_id) USING (new_id)""",
)
def _swapped_body(s, d):
    """Rewritten functions with their status, and how many rows now have their id (the audit's join)."""
    out = w.swap_functions(_functions(s, d)).select("doc_id", "new_id", "new_body", "status", F.coalesce("audited", F.lit(False)).alias("audited"))
    ids = _functions(s, d).groupBy(w.swapped_id("item").alias("new_id")).agg(F.count(F.lit(1)).alias("same_id"))
    return out.join(ids, "new_id")
