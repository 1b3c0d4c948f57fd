"""Queries of code views, over made-up modules whose functions hold the sentences of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import views as v
from rankweave.sources.fixtures import load

from .base import plain


def _code(s, d):
    """doc_id, text, query: of three sentences one is a function, one a function in it, one a plain block; every tenth document is prose."""
    text = F.coalesce("text", F.lit(""))
    inner = lambda x, by: F.replace(x, F.lit("\n"), F.lit("\n" + by))
    one = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("def get_"), i.cast("string"), F.lit("(x):\n    "), inner(x, "    "))).when(i % 3 == 1, F.concat(F.lit("    async def in_"), i.cast("string"), F.lit("(y):\n\n        "), inner(x, "        "), F.lit("\n  \n"))).otherwise(F.concat(F.lit("if True:\n  "), inner(x, "  ")))
    code = F.when(F.col("doc_id") % 10 == 9, text).otherwise(F.array_join(F.transform(F.split(text, r"\. "), one), "\n"))
    return load(s, d, "documents").select("doc_id", code.alias("text"), F.left(text, F.lit(300)).alias("query"))


_SQL = f"""WITH code AS MATERIALIZED (SELECT doc_id, left(t, 300) AS query, CASE WHEN doc_id % 10 = 9 THEN t ELSE array_to_string(list_transform(string_split(t, '. '), lambda x, i: CASE (i - 1) % 3
      WHEN 0 THEN 'def get_' || (i - 1) || '(x):' || chr(10) || '    ' || replace(x, chr(10), chr(10) || '    ')
      WHEN 1 THEN '    async def in_' || (i - 1) || '(y):' || chr(10) || chr(10) || '        ' || replace(x, chr(10), chr(10) || '        ') || chr(10) || '  ' || chr(10)
      ELSE 'if True:' || chr(10) || '  ' || replace(x, chr(10), chr(10) || '  ') END), chr(10)) END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
lined AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM code),
lines AS MATERIALIZED (SELECT doc_id, n, length(regexp_extract(line, '^[ \\t]*')) AS indent, regexp_extract(line, '{v.DEFINED}', 1) AS name FROM lined WHERE regexp_matches(line, '[^ \\t\\r]')),
levels AS MATERIALIZED (SELECT DISTINCT doc_id, indent AS level FROM lines WHERE name <> ''),
spans AS MATERIALIZED (SELECT * FROM (SELECT doc_id, n, name, indent, level, lead(n) OVER (PARTITION BY doc_id, level ORDER BY n) AS next FROM lines JOIN levels USING (doc_id) WHERE indent <= level) WHERE name <> '' AND indent = level),
defined AS MATERIALIZED (SELECT doc_id, n AS start, name, regexp_replace(array_to_string(string_split(text, chr(10))[n + 1:coalesce(next, len(string_split(text, chr(10))))], chr(10)), '[ \\t\\r\\n]+$', '') AS body FROM spans JOIN code USING (doc_id))"""
_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r\\f\\x0B]+'), lambda z: z <> '')"


@plain("code_functions", f"{_SQL} SELECT doc_id, start, name, body FROM defined")
def _functions(s, d):
    return v.functions(_code(s, d), ["doc_id"])


@plain(
    "code_view_bm25_funcs",
    f"""{_SQL},
tf AS MATERIALIZED (SELECT doc_id, start, w, count(*) AS tf FROM (SELECT doc_id, start, unnest(list_concat({_SPLIT.format('body')}, list_filter(string_split(lower(name), '_'), lambda z: z <> ''))) AS w FROM defined) GROUP BY ALL),
sized AS MATERIALIZED (SELECT *, sum(tf) OVER (PARTITION BY doc_id, start) AS size, sum(tf) OVER (PARTITION BY doc_id) AS total FROM tf),
raw AS MATERIALIZED (SELECT doc_id, w, files, ln((files - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT doc_id, w, count(*) AS df FROM tf GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS files FROM defined GROUP BY ALL) USING (doc_id)),
idf AS MATERIALIZED (SELECT doc_id, w, files, CASE WHEN raw < 0 THEN avg(raw) OVER (PARTITION BY doc_id) * {v.EPSILON} ELSE raw END AS idf FROM raw),
wanted AS MATERIALIZED (SELECT doc_id, w, count(*) AS times FROM (SELECT doc_id, unnest({_SPLIT.format('query')}) AS w FROM code) GROUP BY ALL),
scores AS MATERIALIZED (SELECT doc_id, start, sum(times * idf * tf * {v.K1 + 1} / (tf + {v.K1} * ({1 - v.B} + {v.B} * size * files / total))) AS score FROM wanted JOIN idf USING (doc_id, w) JOIN sized USING (doc_id, w) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(score, 0), 6) DESC, start) AS i FROM defined LEFT JOIN scores USING (doc_id, start)),
parts AS (SELECT doc_id, string_agg('# ' || name || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS view FROM best WHERE i <= {v.TOP} GROUP BY doc_id)
SELECT doc_id, left(coalesce(view, array_to_string(string_split(text, chr(10))[1:{v.HEAD}], chr(10))), {v.CAP}) AS view, CASE WHEN view IS NULL THEN 'head' ELSE 'functions' END AS kind FROM code LEFT JOIN parts USING (doc_id)""",
)
def _bm25(s, d):
    """A file's five best functions for its question, or its first lines."""
    return v.views(_code(s, d), ["doc_id"])
