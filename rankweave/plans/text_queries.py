"""Queries of the scalar text family: tokenizers on paths, issues and documents, extractors, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import text as t
from rankweave.sources.fixtures import changes, files, issue_texts, load

from .base import joined, plain, query, r6

# ---- the same rules as DuckDB expressions ------------------------------------------------------------


def _lst(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _re(c: str, p: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, '{p}', '{to}', '{flags}')"


def _camel(c: str, acronyms: bool = False) -> str:
    out = _re(c, "([a-z])([A-Z])", r"\1 \2")
    return _re(out, "([A-Z]+)([A-Z][a-z])", r"\1 \2") if acronyms else out


def _py(c: str) -> str:
    return _re(c, r"\.py$", "", "")


def _long(arr: str, than: int = 1) -> str:
    return f"list_filter({arr}, lambda x: length(x) > {than})"


def _split(c: str, p: str) -> str:
    return f"string_split_regex({c}, '{p}')"


def _base(c: str) -> str:
    return f"string_split({c}, '/')[-1]"


def _dir(c: str) -> str:
    return f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"


def _stem(c: str) -> str:
    return _re(_base(c), r"\.[^.]*$", "", "")


def _basic(c: str) -> str:
    return _long(_split(f"lower({_camel(_py(c))})", r"[/_\s]+"))


def _sep4(c: str) -> str:
    return _long(_split(f"lower({_camel(_py(c), True)})", r"[/_\-.\s]+"))


def _strict(c: str) -> str:
    return _long(_split(f"lower({_camel(_py(c))})", r"[/_\-.\s]+"))


def _set(c: str) -> str:
    return _first_seen(_long(_split(f"lower({c})", r"[/._\-]+")))


def _first_seen(arr: str) -> str:
    """Distinct values in the order of their first place."""
    return f"list_reduce(list_transform({arr}, lambda z: [z]), lambda p, q: CASE WHEN list_contains(p, q[1]) THEN p ELSE list_concat(p, q) END, [''])[2:]"


def _ident(c: str, stop: list[str]) -> str:
    return _drop(_long(f"regexp_extract_all(lower({_re(_camel(c, True), '[_/\\-.]', ' ')}), '[a-z][a-z0-9]*')"), stop)


def _camel_words(arr: str, acronyms: bool = False) -> str:
    return f"coalesce(flatten(list_transform({arr}, lambda y: string_split(lower({_camel('y', acronyms)}), ' '))), [])"


def _drop(arr: str, stop: list[str]) -> str:
    return f"list_filter({arr}, lambda x: NOT list_contains({_lst(stop)}, x))"


def _times(arr: str, n: int) -> str:
    return "list_concat(" * (n - 1) + arr + f", {arr})" * (n - 1)


def _cat(*arrs: str) -> str:
    out = arrs[0]
    for a in arrs[1:]:
        out = f"list_concat({out}, {a})"
    return out


def _refs(c: str) -> str:
    return rf"regexp_extract_all({c}, '[\w/]+\.py\b')"


def _parts(arr: str, fn=_strict) -> str:
    return f"coalesce(flatten(list_transform({arr}, lambda y: {fn('y')})), [])"


def _lower(arr: str) -> str:
    return f"list_transform({arr}, lambda x: lower(x))"


def _quoted(c: str) -> str:
    return _lower(rf"regexp_extract_all({c}, '[`\"''](\w+)[`\"'']', 1)")


def _quoted_parts(c: str) -> str:
    return _long(rf"coalesce(flatten(list_transform(regexp_extract_all({c}, '[`\"'']([\w.]+)[`\"'']', 1), lambda y: string_split_regex(lower(y), '[._]'))), [])")


def _dotted(c: str, least: int) -> str:
    return rf"coalesce(flatten(list_transform(regexp_extract_all({c}, '\b\w+(?:\.\w+){{{least},}}\b'), lambda x: string_split(lower(x), '.'))), [])"


def _ref_parts(c: str) -> str:
    return _long(rf"coalesce(flatten(list_transform({_refs(c)}, lambda y: string_split_regex(lower(replace(y, '.py', '')), '[/_\-.]'))), [])")


def _improved(c: str) -> str:
    return _cat(_strict(c), _strict(_base(c)), _strict(_dir(c)), _long(f"[lower(replace({_py(c)}, '/', '.'))]"))


_WHOLE = r"regexp_extract_all({}, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')"


def _paths(name: str, fn, sql_fn) -> None:
    """A path tokenizer over every file."""
    sql = f"SELECT repo, path, array_to_string({sql_fn('path')}, ' ') AS tokens FROM files"
    query(name, sql)(lambda s, d: files(s, d).select("repo", "path", joined(fn("path")).alias("tokens")))


def _issues(name: str, fn, sql_fn) -> None:
    """An issue tokenizer over every issue text."""
    sql = f"SELECT repo, issue_id, array_to_string({sql_fn('text')}, ' ') AS tokens FROM texts"
    query(name, sql)(lambda s, d: issue_texts(s, d).select("repo", "issue_id", joined(fn("text")).alias("tokens")))


_paths("tok_path_basic", t.tok_path_basic, _basic)
_paths("tok_path_sep4", t.tok_path_sep4, _sep4)
_paths("tok_path_strict", t.tok_path_strict, _strict)
_paths("tok_path_improved", t.tok_path_improved, _improved)
_paths("tok_path_set", t.tok_path_set, _set)
_paths("tok_path_java", t.tok_path_java, lambda c: _long(_split(f"lower({_re(c, '([A-Z])', r' \1')})", r"[/._\-\s]+")))
_paths("tok_path_components", t.tok_path_components, lambda c: _first_seen(_cat(f"string_split(lower({_py(c)}), '/')", _long(f"flatten(list_transform(string_split(lower({_py(c)}), '/'), lambda y: {_split('y', r'[_\-.]+')}))"))))
_paths("camel_split_simple", lambda c: F.array(t.split_camel(c)), lambda c: f"[{_camel(c)}]")
_paths("stem_normalize", lambda c: F.array(t.stem_normalize(c)), lambda c: f"[{_re(_re(_stem(c), '^tests?_', '', ''), '_tests?$', '', '')}]")

_issues("tok_code_v2", t.tok_code_v2, lambda c: _ident(c, t.CODE_V2_STOP))
_issues("tok_code_strict", t.tok_code_strict, lambda c: _ident(c, t.CODE_STOP))
_issues("tok_code_pystrip", t.tok_code_pystrip, lambda c: _drop(_long(_camel_words(f"regexp_extract_all({_re(_re(_re(c, '(?m)#.*$', ''), '(?s)""".*?"""', ''), "(?s)''''''.*?''''''", '')}, '[a-zA-Z_][a-zA-Z0-9_]*')")), t.PY_STOP))
_issues("tok_text_stem", t.tok_text_stem, lambda c: _long(f"regexp_extract_all(lower({_camel(c, True)}), '[a-z][a-z0-9]*')"))
_issues("tok_issue_basic", t.tok_issue_basic, lambda c: _long(f"regexp_extract_all({_re(f'lower({c})', r'^title:\s*', '', '')}, '[a-z_][a-z0-9_]*')"))
_issues("tok_issue_improved", t.tok_issue_improved, lambda c: _drop(_long(_cat(f"regexp_extract_all(lower({c}), '[a-z_][a-z0-9_]*')", _camel_words(_WHOLE.format(c)), _lower(_WHOLE.format(c)), _times(_parts(_refs(c), _improved), 2), _dotted(c, 2), _quoted(c))), t.ISSUE_STOP))
_issues("tok_issue_v2", t.tok_issue_v2, lambda c: _cat(_drop(_long(_camel_words(f"regexp_extract_all({c}, '[A-Za-z_][A-Za-z0-9_]*')", True), 2), t.CODE_V2_STOP), _long(_parts(_refs(c), _sep4), 2), _drop(_long(_quoted(c), 2), t.CODE_V2_STOP)))
_issues("tok_query_strict", t.tok_query_strict, lambda c: _cat(_ident(c, t.CODE_STOP), _times(_parts(_refs(c)), 3), _long(_quoted(c)), _dotted(c, 2)))
_issues("tok_query_chunk", t.tok_query_chunk, lambda c: _cat(_long(f"regexp_extract_all(lower({_camel(c, True)}), '[a-z][a-z0-9]*')"), _times(_ref_parts(c), 3), _times(_quoted_parts(c), 2), _times(_long(_dotted(c, 1)), 2)))
_TRACE = r"""list_transform(list_distinct(regexp_extract_all({}, 'File "([^"]+\.py)"', 1)), lambda x: regexp_replace(x, '^.*/(?:site-packages|dist-packages|lib)/', ''))"""
_issues(
    "tok_query_enhanced",
    t.tok_query_enhanced,
    lambda c: _cat(
        _ident(c, t.ENHANCED_STOP), _times(_ref_parts(c), 4), _times(_quoted_parts(c), 3), _times(_long(_dotted(c, 1)), 3),
        _times(_parts(rf"regexp_extract_all({c}, '\b\w+(?:Error|Exception|Warning|Failure)\b')", lambda y: _ident(y, t.ENHANCED_STOP)), 4),
        _times(_long(_lower(rf"regexp_extract_all({c}, 'in\s+(\w+)', 1)"), 2), 2),
        _times(_long(_lower(rf"""regexp_extract_all({c}, 'File\s+"[^"]*?(\w+)\.py"', 1)"""), 2), 3),
        _times(_long(_lower(rf"regexp_extract_all({c}, '(?:def|class)\s+(\w+)', 1)")), 3),
    ),
)
_issues("ext_traceback", t.ext_traceback, lambda c: _TRACE.format(c))
_MODULES = rf"list_filter(regexp_extract_all({{}}, '\b[a-z_]\w*(?:\.[a-z_]\w*)+\b'), lambda x: NOT regexp_matches(x, '^(?:e\.g|i\.e|http|www|v1|v2)') AND NOT ends_with(x, '.py'))"
_issues("ext_module_paths", t.ext_module_paths, lambda c: _first_seen(f"flatten(list_transform({_MODULES.format(c)}, lambda x: [replace(x, '.', '/') || '.py', replace(regexp_replace(x, '\\.[^.]*$', ''), '.', '/') || '.py']))"))
_issues("has_stack_trace", lambda c: F.array(t.has_stack_trace(c).cast("string")), lambda c: rf"""[regexp_matches({c}, 'Traceback \(most recent call last\)|File "[^"]+", line \d+|\bException in thread\b|\b\w+(?:Error|Exception): ')::VARCHAR]""")


@plain("tok_alnum", "SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM conversations")
def _alnum(s, d):
    return load(s, d, "conversations").select("conv_id", "turn", joined(t.tok_alnum("text")).alias("tokens"))


@plain("scan_head_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head FROM documents")
def _head(s, d):
    return load(s, d, "documents").select("doc_id", t.head_lines("text", 3).alias("head"))


_CHUNK = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 500 THEN [0] ELSE range(0, len(w), 450) END) AS s FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS chunk, md5(array_to_string(w[s + 1:s + 500], ' ')) AS digest FROM c
"""


@plain("chunk_words", _CHUNK)
def _chunks(s, d):
    return load(s, d, "documents").select("doc_id", F.posexplode(t.chunk_words("text")).alias("chunk", "c")).select("doc_id", "chunk", F.md5("c").alias("digest"))


@query("doc_weight_path3", f"SELECT repo, issue_id, array_to_string({_cat(_times(_strict('path'), 3), _ident('text', t.CODE_STOP))}, ' ') AS tokens FROM texts")
def _path3(s, d):
    return issue_texts(s, d).select("repo", "issue_id", joined(t.doc_weight_path3("path", "text")).alias("tokens"))


@query("tok_query_keywords", f"SELECT repo, issue_id, array_to_string({_cat(_times(f'flatten(list_transform([{_stem("path")}, path], lambda y: {_ident("y", t.CODE_STOP)}))', 3), _times(_parts('[path]'), 5), _ident('left(text, 1000)', t.CODE_STOP))}, ' ') AS tokens FROM texts")
def _keywords(s, d):
    return issue_texts(s, d).select("repo", "issue_id", joined(t.tok_query_keywords("text", F.array(t.stem("path"), F.col("path")))).alias("tokens"))


@query("has_file_mention", f"SELECT repo, issue_id, contains(text, {_base('path')}) OR (length({_stem('path')}) > 3 AND contains(text, {_stem('path')})) OR contains(text, array_to_string(string_split(path, '/')[-2:], '/')) AS mentioned FROM texts")
def _mention(s, d):
    return issue_texts(s, d).select("repo", "issue_id", t.has_file_mention(F.col("text"), F.array("path")).alias("mentioned"))


_MENTIONED = f"m AS (SELECT repo, issue_id, ['packages/' || path, path] AS paths, [{_base('path')}] AS names, list_sort(list_distinct(['crash', 'keyerror', 'repo', 'title', lower({_stem('path')}), regexp_extract(lower({_stem('path')}), '^[a-z]+')])) AS keywords FROM texts)"


@query("ext_file_mentions", "+" + _MENTIONED + " SELECT repo, issue_id, array_to_string(paths, ' ') AS paths, array_to_string(names, ' ') AS names, array_to_string(keywords, ' ') AS keywords FROM m")
def _file_mentions(s, d):
    return issue_texts(s, d).select("repo", "issue_id", t.ext_file_mentions("text").alias("m")).select("repo", "issue_id", joined("m.paths").alias("paths"), joined("m.names").alias("names"), joined("m.keywords").alias("keywords"))


@query("ext_mentions_simple", rf"SELECT repo, issue_id, array_to_string({_first_seen(r"regexp_extract_all(text, '\w+(?:/\w+)+\.py')")}, ' ') AS paths, array_to_string({_first_seen("regexp_extract_all(text, '[`\"''](\\w+)[`\"'']', 1)")}, ' ') AS quoted FROM texts")
def _mentions(s, d):
    return issue_texts(s, d).select("repo", "issue_id", t.ext_mentions("text").alias("m")).select("repo", "issue_id", joined("m.paths").alias("paths"), joined("m.quoted").alias("quoted"))


@query("ext_paths_delimited", f"SELECT repo, issue_id, '/usr/lib/site-packages/' || path || ' ' || path || ' ' || {_base('path')} AS paths FROM texts")
def _delimited(s, d):
    return issue_texts(s, d).select("repo", "issue_id", joined(t.ext_paths_delimited("text")).alias("paths"))


_TEST = r"regexp_matches({c}, '(?:^|/)(?:tests?|testing)/') OR regexp_matches({b}, '^test_.*|_test\.py$|^conftest\.py$')"


@query("is_test_file", f"SELECT repo, path, {_TEST.format(c='tp', b=_base('tp'))} AS is_test, contains(lower({_stem('tp')}), 'test') AS loose, {_base('tp')} = 'conf.py' OR regexp_matches(tp, '^docs?/') OR contains(tp, 'makemigrations') AS junk FROM (SELECT repo, path, CASE length(path) % 4 WHEN 0 THEN 'tests/' || path WHEN 1 THEN 'docs/' || path WHEN 2 THEN replace(path, '.py', '_test.py') ELSE path END AS tp FROM files)")
def _tests(s, d):
    n = F.length("path") % 4
    tp = F.when(n == 0, F.concat(F.lit("tests/"), "path")).when(n == 1, F.concat(F.lit("docs/"), "path")).when(n == 2, F.replace("path", F.lit(".py"), F.lit("_test.py"))).otherwise(F.col("path"))
    return files(s, d).withColumn("tp", tp).select("repo", "path", t.is_test_file("tp").alias("is_test"), t.is_test_loose("tp").alias("loose"), t.is_junk_file("tp").alias("junk"))


def _pairs(s, d):
    """The files of one issue, pair by pair."""
    ch = changes(s, d).select("repo", "issue_id", "path")
    return ch.withColumnRenamed("path", "a").join(ch.withColumnRenamed("path", "b"), ["repo", "issue_id"]).where("a < b")


_PAIRS = "+pairs AS (SELECT x.repo, x.issue_id, x.path AS a, y.path AS b FROM changes x JOIN changes y ON x.issue_id = y.issue_id AND x.path < y.path) "
_DEPTH = f"len(list_filter(range(1, 1 + least(len(string_split({_dir('a')}, '/')), len(string_split({_dir('b')}, '/')))), lambda i: string_split({_dir('a')}, '/')[1:i] = string_split({_dir('b')}, '/')[1:i]))"


@query("dir_distance_hops", _PAIRS + f"SELECT issue_id, a, b, (len(string_split({_dir('a')}, '/')) + len(string_split({_dir('b')}, '/')) - 2 * {_DEPTH})::INTEGER AS hops, {_DEPTH}::INTEGER AS depth FROM pairs")
def _hops(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", t.dir_distance_hops("a", "b").alias("hops"), t.shared_prefix_depth("a", "b").alias("depth"))


@query("shared_prefix_depth", _PAIRS + f"SELECT issue_id, a, b, {_DEPTH}::INTEGER AS depth FROM pairs")
def _depth(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", t.shared_prefix_depth("a", "b").alias("depth"))


@query("dir_distance_class", _PAIRS + f"SELECT issue_id, a, b, CASE WHEN {_dir('a')} = {_dir('b')} THEN 0 WHEN {_dir(_dir('a'))} = {_dir(_dir('b'))} THEN 1 ELSE 2 END AS class, CASE WHEN {_base('a')} = {_base('b')} THEN 'same_name' WHEN {_stem('a')} = {_stem('b')} THEN 'test_variant' ELSE 'different' END AS names FROM pairs")
def _class(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", t.dir_distance_class("a", "b").alias("class"), t.basename_similarity("a", "b").alias("names"))


@query("edit_distance_char", _PAIRS + "SELECT issue_id, a, b, levenshtein(a, b)::INTEGER AS distance FROM pairs")
def _edit(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", F.levenshtein("a", "b").alias("distance"))


@query("edit_distance_component", _PAIRS + "SELECT issue_id, a, b, (3 - list_sum(list_transform([1, 2, 3], lambda i: (string_split(a, '/')[i] = string_split(b, '/')[i])::INTEGER)))::INTEGER AS distance FROM pairs")
def _edit_component(s, d):
    """Fixture paths have three components of disjoint vocabularies, so the oracle may compare place by place."""
    return _pairs(s, d).select("issue_id", "a", "b", t.edit_distance_component("a", "b").alias("distance"))


@query("jaccard", _PAIRS + f"SELECT issue_id, a, b, round(len(list_intersect({_set('a')}, {_set('b')})) / len(list_distinct(list_concat({_set('a')}, {_set('b')}))), 6) AS jaccard FROM pairs")
def _jaccard(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", r6(t.jaccard(t.tok_path_set("a"), t.tok_path_set("b"))).alias("jaccard"))


@query("jaccard_empty1", _PAIRS + f"SELECT issue_id, a, b, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS jaccard FROM (SELECT *, list_filter({_set('a')}, lambda z: length(z) > 7) AS x, list_filter({_set('b')}, lambda z: length(z) > 7) AS y FROM pairs)")
def _jaccard1(s, d):
    long = lambda c: F.filter(t.tok_path_set(c), lambda z: F.length(z) > 7)
    return _pairs(s, d).select("issue_id", "a", "b", r6(t.jaccard(long("a"), long("b"), 1.0)).alias("jaccard"))


@query("path_similarity", _PAIRS + f"SELECT issue_id, a, b, round(len(list_intersect({_set('a')}, {_set('b')})) / len(list_distinct(list_concat({_set('a')}, {_set('b')}))), 6) AS similarity FROM pairs")
def _similarity(s, d):
    return _pairs(s, d).select("issue_id", "a", "b", r6(t.jaccard(t.tok_path_set("a"), t.tok_path_set("b"))).alias("similarity"))


_WORDS_OF = r"regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')"


@query("path_coverage", f"SELECT repo, issue_id, round(len(list_intersect({_set('path')}, {_WORDS_OF})) / len({_set('path')}), 6) AS coverage, round(len(list_filter({_set('path')}, lambda x: contains(lower(text), x))) / len({_set('path')}), 6) AS overlap FROM texts")
def _coverage(s, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    return issue_texts(s, d).select("repo", "issue_id", r6(t.coverage(words, t.tok_path_set("path"))).alias("coverage"), r6(t.lexical_overlap(F.col("text"), t.tok_path_set("path"))).alias("overlap"))


@query("path_overlap_router", rf"SELECT repo, issue_id, round(len(list_intersect({_set('path')}, string_split_regex(lower(text), '\W+'))) / len({_set('path')}), 6) AS overlap FROM texts")
def _router(s, d):
    return issue_texts(s, d).select("repo", "issue_id", r6(t.coverage(F.split(F.lower("text"), r"\W+"), t.tok_path_set("path"))).alias("overlap"))


@query("lexical_overlap", f"SELECT repo, issue_id, round(len(list_filter({_set('path')}, lambda x: contains(lower(text), x))) / len({_set('path')}), 6) AS overlap FROM texts")
def _lexical(s, d):
    return issue_texts(s, d).select("repo", "issue_id", r6(t.lexical_overlap(F.col("text"), t.tok_path_set("path"))).alias("overlap"))


@query("overlap_log", f"SELECT repo, issue_id, round(len(list_intersect(p, {_drop(_WORDS_OF, t.STOP)})) / (1 + ln(1 + len(p))), 6) AS score FROM (SELECT *, {_drop(_set('path'), t.STOP)} AS p FROM texts)")
def _log(s, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    return issue_texts(s, d).select("repo", "issue_id", r6(t.overlap_log(words, t.tok_path_set("path"))).alias("score"))


@query("score_text_candidate", "+" + _MENTIONED + f", h AS (SELECT c.repo, c.issue_id, c.path, paths, names, len(list_intersect(list_distinct({_set('c.path')}), keywords)) AS hits FROM changes c JOIN m USING (repo, issue_id)) SELECT repo, issue_id, path, round((CASE WHEN list_contains(paths, path) THEN 2.0 ELSE len(list_filter(paths, lambda p: ends_with(path, p) OR ends_with(p, path))) END + CASE WHEN list_contains(names, {_base('path')}) THEN 1.5 ELSE 0.0 END + 0.3 * hits) * CASE WHEN hits >= 2 THEN 1.3 ELSE 1.0 END, 6)::DOUBLE AS score FROM h")
def _text_score(s, d):
    texts = issue_texts(s, d).withColumn("m", t.ext_file_mentions("text")).select("repo", "issue_id", "m")
    ch = changes(s, d).select("repo", "issue_id", "path")
    return ch.join(texts, ["repo", "issue_id"]).select("repo", "issue_id", "path", r6(t.score_text_candidate("path", F.col("m.paths"), F.col("m.names"), F.col("m.keywords"))).alias("score"))


@query("prompt_build", "SELECT repo, issue_id, 'Issue: ' || left(text, 100) || chr(10) || 'File: ' || path || chr(10) || 'Code: ' || left(text, 50) || chr(10) || 'Relevant? ' AS prompt FROM texts")
def _prompt(s, d):
    return issue_texts(s, d).select("repo", "issue_id", t.prompt_build(F.col("text"), F.col("path"), F.col("text"), 100, 50).alias("prompt"))


@query("truncate_suffix", "SELECT repo, issue_id, array_to_string(list_concat(string_split(text, ' ')[1:10], ['the', 'answer']), ' ') AS tokens FROM texts")
def _suffix(s, d):
    return issue_texts(s, d).select("repo", "issue_id", joined(t.truncate_suffix(F.split("text", " "), F.array(F.lit("the"), F.lit("answer")), 12)).alias("tokens"))


@query("parse_keywords", "SELECT repo, issue_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[,;\n]'), lambda x: trim(regexp_replace(trim(x, ' '), '^-+\\s*|\\s*-+$', '', 'g'), ' ')), lambda x: length(x) > 1), '|') AS keywords FROM texts")
def _parse(s, d):
    return issue_texts(s, d).select("repo", "issue_id", F.array_join(t.parse_keywords("text"), "|").alias("keywords"))


_TEST_PAIR = f"CASE WHEN {_TEST.format(c='path', b=_base('path'))} THEN NULL ELSE [{_dir('path')} || '/test_' || {_stem('path')} || '.py', {_dir('path')} || '/tests/test_' || {_stem('path')} || '.py', {_dir('path')} || '/' || {_stem('path')} || '_test.py', {_dir('path')} || '/test/test_' || {_stem('path')} || '.py'] END"


@query("test_pair", f"+twins AS (SELECT repo, {_dir('path')} || '/test_' || {_base('path')} AS twin FROM files WHERE length(path) % 3 = 0) SELECT f.repo, f.path, twin FROM (SELECT repo, path, unnest({_TEST_PAIR}) AS want FROM files) f JOIN twins ON twins.repo = f.repo AND twin = want")
def _test_pair(s, d):
    """Test twins, made for a third of the files, are found from their sources."""
    own = files(s, d)
    twins = own.where(F.length("path") % 3 == 0).select("repo", F.concat(t.dirname("path"), F.lit("/test_"), t.basename("path")).alias("twin"))
    return own.select("repo", "path", F.explode(t.test_pair("path")).alias("twin")).join(twins, ["repo", "twin"]).select("repo", "path", "twin")
