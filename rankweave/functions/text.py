"""Tokenizers, extractors and path predicates as Column expressions; everything stays inside codegen.

Word lists are fixed values of the retrieval task: they decide results, so they are stated plainly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop list of code tokens in candidate building.
CODE_V2_STOP = "the and for not but are was has had can may use def class self return import from if else elif try except with as in is or none true false pass raise this that will would should could title".split()
#: The stop list of code tokens in per-commit retrieval.
CODE_STOP = "the and for not but are was has had can may use def class self return import from if else elif try except with as in is or none true false pass raise this that will would should could".split()
#: The stop list of code tokens in enhanced queries.
ENHANCED_STOP = "the and for not but are was has had can may use def class self return import from if else elif try except with as in is or none true false pass raise".split()
#: Python keywords that are no content tokens.
PY_STOP = "self def class return import from if else elif for while try except with as in not and or is none true false pass break continue raise yield lambda global nonlocal assert del print".split()
#: The stop list of improved issue tokens.
ISSUE_STOP = "this that with from have been when what does should could would will than then also into some other more after before title description the and for not but are was were has had can may use using used like just about get set".split()
#: Words that carry no signal in overlap scores and titles.
STOP = "the a an is are was were be been to of and in that it for on with as at by from or this not but if when has have had do does did will would can could should".split()

LOWER_UPPER, UPPER_WORD = r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda x: ~x.isin(stop))


def _longer(words: Column, than: int = 1) -> Column:
    return F.filter(words, lambda x: F.length(x) > than)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _times(words: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(words, n))


def split_camel(c: str | Column, acronyms: bool = False) -> Column:
    """camelCase to words; with acronyms HTTPServer becomes HTTP Server."""
    out = F.regexp_replace(_col(c), LOWER_UPPER, "$1 $2")
    return F.regexp_replace(out, UPPER_WORD, "$1 $2") if acronyms else out


def strip_py(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"\.py$", "")


def tok_path_basic(c: str | Column) -> Column:
    return _longer(F.split(F.lower(split_camel(strip_py(c))), r"[/_\s]+"))


def tok_path_sep4(c: str | Column) -> Column:
    return _longer(F.split(F.lower(split_camel(strip_py(c), acronyms=True)), r"[/_\-.\s]+"))


def tok_path_strict(c: str | Column) -> Column:
    return _longer(F.split(F.lower(split_camel(strip_py(c))), r"[/_\-.\s]+"))


def basename(c: str | Column) -> Column:
    return F.substring_index(_col(c), "/", -1)


def dirname(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), r"^(.*)/[^/]*$", 1)


def stem(c: str | Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def tok_path_improved(c: str | Column) -> Column:
    """Tokens of the path, again of its file name and of its directory, and the dotted path."""
    return F.concat(tok_path_strict(c), tok_path_strict(basename(c)), tok_path_strict(dirname(c)), _longer(F.array(F.lower(F.replace(strip_py(c), F.lit("/"), F.lit("."))))))


def tok_path_set(c: str | Column) -> Column:
    return F.array_distinct(_longer(F.split(F.lower(_col(c)), r"[/._\-]+")))


def tok_path_java(c: str | Column) -> Column:
    """Breaks before every capital letter."""
    return _longer(F.split(F.lower(F.regexp_replace(_col(c), r"([A-Z])", " $1")), r"[/._\-\s]+"))


def tok_path_components(c: str | Column) -> Column:
    """The set of path components and their sub-tokens."""
    own = F.split(F.lower(strip_py(c)), "/")
    return F.array_distinct(F.concat(own, _longer(F.flatten(F.transform(own, lambda x: F.split(x, r"[_\-.]+"))))))


def _code(c: str | Column, stop: list[str]) -> Column:
    """Both camel rules, separators as spaces, words that begin with a letter."""
    return _without(_longer(_all(F.lower(F.regexp_replace(split_camel(c, acronyms=True), r"[_/\-.]", " ")), "[a-z][a-z0-9]*")), stop)


def tok_code_v2(c: str | Column) -> Column:
    return _code(c, CODE_V2_STOP)


def tok_code_strict(c: str | Column) -> Column:
    return _code(c, CODE_STOP)


def tok_code_pystrip(c: str | Column) -> Column:
    """Identifiers of Python source without comments and docstrings."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), "(?m)#.*$", ""), '(?s)""".*?"""', ""), "(?s)'''.*?'''", "")
    return _without(_longer(_camel_words(_all(bare, "[a-zA-Z_][a-zA-Z0-9_]*"))), PY_STOP)


def _camel_words(names: Column, acronyms: bool = False) -> Column:
    return F.flatten(F.transform(names, lambda x: F.split(F.lower(split_camel(x, acronyms)), " ")))


def tok_text_stem(c: str | Column) -> Column:
    """Two camel rules and words that begin with a letter; stemming is left to the caller."""
    return _longer(_all(F.lower(split_camel(c, acronyms=True)), "[a-z][a-z0-9]*"))


def tok_alnum(c: str | Column) -> Column:
    return _all(F.lower(_col(c)), "[a-z0-9]+")


def tok_issue_basic(c: str | Column) -> Column:
    return _longer(_all(F.regexp_replace(F.lower(_col(c)), r"^title:\s*", ""), "[a-z_][a-z0-9_]*"))


def py_refs(c: str | Column) -> Column:
    return _all(_col(c), r"[\w/]+\.py\b")


def quoted(c: str | Column) -> Column:
    return _all(_col(c), "[`\"'](\\w+)[`\"']", 1)


def _quoted_parts(c: str | Column) -> Column:
    """Parts of quoted names, which may have dots."""
    found = _all(_col(c), "[`\"']([\\w.]+)[`\"']", 1)
    return _longer(F.flatten(F.transform(found, lambda x: F.split(F.lower(x), "[._]"))))


def dotted(c: str | Column, least: int) -> Column:
    """Dotted names with at least so many dots, in parts."""
    names = _all(_col(c), r"\b\w+(?:\.\w+){" + str(least) + r",}\b")
    return F.flatten(F.transform(names, lambda x: F.split(F.lower(x), r"\.")))


def _parts_of(words: Column, fn=tok_path_strict) -> Column:
    return F.flatten(F.transform(words, fn))


def _ref_parts(c: str | Column) -> Column:
    """Parts of ``.py`` references, without camel rules."""
    return _longer(F.flatten(F.transform(py_refs(c), lambda x: F.split(F.lower(F.replace(x, F.lit(".py"), F.lit(""))), r"[/_\-.]"))))


def _lower(words: Column) -> Column:
    return F.transform(words, F.lower)


def tok_issue_improved(c: str | Column) -> Column:
    camel = _all(_col(c), r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")
    own = F.concat(_all(F.lower(_col(c)), "[a-z_][a-z0-9_]*"), _camel_words(camel), _lower(camel), _times(_parts_of(py_refs(c), tok_path_improved), 2), dotted(c, 2), _lower(quoted(c)))
    return _without(_longer(own), ISSUE_STOP)


def tok_issue_v2(c: str | Column) -> Column:
    words = _without(_longer(_camel_words(_all(_col(c), "[A-Za-z_][A-Za-z0-9_]*"), acronyms=True), 2), CODE_V2_STOP)
    return F.concat(words, _longer(_parts_of(py_refs(c), tok_path_sep4), 2), _without(_longer(_lower(quoted(c)), 2), CODE_V2_STOP))


def tok_query_strict(c: str | Column) -> Column:
    return F.concat(tok_code_strict(c), _times(_parts_of(py_refs(c)), 3), _longer(_lower(quoted(c))), dotted(c, 2))


def tok_query_chunk(c: str | Column) -> Column:
    return F.concat(tok_text_stem(c), _times(_ref_parts(c), 3), _times(_quoted_parts(c), 2), _times(_longer(dotted(c, 1)), 2))


def tok_query_enhanced(c: str | Column) -> Column:
    errors = F.flatten(F.transform(_all(_col(c), r"\b\w+(?:Error|Exception|Warning|Failure)\b"), lambda x: _code(x, ENHANCED_STOP)))
    inside = _longer(_lower(_all(_col(c), r"in\s+(\w+)", 1)), 2)
    traced = _longer(_lower(_all(_col(c), r'File\s+"[^"]*?(\w+)\.py"', 1)), 2)
    defined = _longer(_lower(_all(_col(c), r"(?:def|class)\s+(\w+)", 1)))
    return F.concat(_code(c, ENHANCED_STOP), _times(_ref_parts(c), 4), _times(_quoted_parts(c), 3), _times(_longer(dotted(c, 1)), 3), _times(errors, 4), _times(inside, 2), _times(traced, 3), _times(defined, 3))


def tok_query_keywords(c: str | Column, keywords: Column) -> Column:
    """Model-given keywords three times, path-like ones five times, and the first 1,000 characters once."""
    paths = F.filter(keywords, lambda x: x.contains("/") | x.endswith(".py"))
    return F.concat(_times(F.flatten(F.transform(keywords, tok_code_strict)), 3), _times(_parts_of(paths), 5), tok_code_strict(F.left(_col(c), F.lit(1000))))


def doc_weight_path3(path: str | Column, code: str | Column) -> Column:
    return F.concat(_times(tok_path_strict(path), 3), tok_code_strict(code))


def doc_weight_entity(path: Column, name: Column, docstring: Column, code: Column) -> Column:
    return F.concat(_times(tok_path_strict(path), 3), _times(tok_code_strict(name), 5), _times(tok_code_strict(docstring), 4), tok_code_strict(code))


def doc_weight_func(func_id: str | Column, text: str | Column) -> Column:
    """The id's tokens three times and the body, without a first line that repeats the id."""
    body = F.when(F.substring_index(_col(text), "\n", 1) == _col(func_id), F.regexp_replace(_col(text), r"^[^\n]*\n?", "")).otherwise(_col(text))
    return F.concat(_times(tok_path_strict(func_id), 3), tok_code_strict(body))


def chunk_words(c: str | Column, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping word chunks; a text of up to ``size`` words is one chunk. The last chunk may lie inside the one before."""
    words = F.filter(F.split(_col(c), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) <= size, F.array(F.array_join(words, " "))).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def head_lines(c: str | Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(_col(c), "\n"), 1, n), "\n")


# ---- extractors and predicates -----------------------------------------------------------------------


def ext_mentions(c: str | Column) -> Column:
    """(paths, file names, quoted identifiers) named in a text."""
    return F.struct(F.array_distinct(_all(_col(c), r"\w+(?:/\w+)+\.py")).alias("paths"), F.array_distinct(_all(_col(c), r"(?<![\w/])\w+\.py\b")).alias("names"), F.array_distinct(quoted(c)).alias("quoted"))


def ext_file_mentions(c: str | Column) -> Column:
    """(paths, base names, keywords): keywords are back-ticked, CamelCase and snake_case names, and title words."""
    found = ext_mentions(c)
    ticked = _all(_col(c), "`([A-Za-z_]\\w*)`", 1)
    camel, snake = _all(_col(c), r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"), _all(_col(c), r"\b[a-z]+(?:_[a-z]+)+\b")
    title = _without(_longer(_all(F.lower(F.substring_index(_col(c), "\n", 1)), "[a-z]+"), 2), STOP)
    return F.struct(found["paths"].alias("paths"), F.array_distinct(F.transform(F.concat(found["paths"], found["names"]), basename)).alias("names"), F.array_sort(F.array_distinct(F.concat(F.transform(F.concat(ticked, camel, snake), F.lower), title))).alias("keywords"))


def ext_paths_delimited(c: str | Column) -> Column:
    """Paths that stand between delimiters, without a trailing line number."""
    found = _all(_col(c), r"(?:^|[\s\"'(`,;])([\w./\-]+\.py(?::\d+)?)(?=$|[\s\"')`,;:])", 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r":\d+$", "")))


def ext_traceback(c: str | Column) -> Column:
    """Files of traceback frames, cut after an installation directory."""
    return F.array_distinct(F.transform(_all(_col(c), r'File "([^"]+\.py)"', 1), lambda x: F.regexp_replace(x, r"^.*/(?:site-packages|dist-packages|lib)/", "")))


def ext_module_paths(c: str | Column) -> Column:
    """Dotted modules as a file and as their parent's file; abbreviations and hosts don't count."""
    names = F.filter(_all(_col(c), r"\b[a-z_]\w*(?:\.[a-z_]\w*)+\b"), lambda x: ~x.rlike(r"^(?:e\.g|i\.e|http|www|v1|v2)") & ~x.endswith(".py"))
    path = lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.array_distinct(F.flatten(F.transform(names, lambda x: F.array(path(x), path(F.regexp_replace(x, r"\.[^.]*$", ""))))))


def has_stack_trace(c: str | Column) -> Column:
    return _col(c).rlike(r"Traceback \(most recent call last\)|File \"[^\"]+\", line \d+|(?m)^\s+at \w|\bException in thread\b|\b\w+(?:Error|Exception): ")


def has_file_mention(text: Column, truth: Column) -> Column:
    """Whether a true file's name, stem (of over 3 letters) or last two components stand in the text."""
    last_two = lambda g: F.substring_index(g, "/", -2)
    return F.exists(truth, lambda g: text.contains(basename(g)) | (F.length(stem(g)) > 3) & text.contains(stem(g)) | text.contains(last_two(g)))


def ext_patch_files(c: str | Column) -> Column:
    git, plus = _all(_col(c), r"(?m)^diff --git a/(.+?) b/(.+?)$", 2), _all(_col(c), r"(?m)^\+\+\+ b/(.+?)$", 1)
    return F.array_distinct(F.concat(git, plus))


def parse_pred_list(c: str | Column) -> Column:
    """A numbered, bulleted or back-ticked list of paths, one a line."""
    lines = F.transform(F.split(_col(c), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", ""), "`", "")))
    return F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^[\w./\-]+\.\w+$")))


def _padded(order: Column, n: Column) -> Column:
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.array_distinct(F.filter(order, lambda x: (x >= 0) & (x < n)))
    return F.concat(own, F.array_except(every, own))


def parse_rank_letters(c: str | Column, n: Column) -> Column:
    """``[B] > [A]`` as indices, or bare letters; items that aren't named follow in order."""
    bracket, bare = _all(_col(c), r"\[([A-Z])\]", 1), _all(_col(c), r"\b([A-Z])\b(?=\s*(?:>|,|$))", 1)
    return _padded(F.transform(F.when(F.size(bracket) > 0, bracket).otherwise(bare), lambda x: F.ascii(x) - 65), n)


def _numbers(c: str | Column, pattern: str) -> Column:
    return F.transform(_all(_col(c), pattern, 1), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)) - 1)


def parse_rank_numbers(c: str | Column, n: Column) -> Column:
    """A first line with commas, else the number that begins each line; the rest in order."""
    line = F.substring_index(F.trim(_col(c)), "\n", 1)
    comma = _numbers(line, r"(\d+)")
    return _padded(F.when(line.contains(","), comma).otherwise(_numbers(c, r"(?m)^\s*\[?(\d+)")), n)


def parse_rank_frontier(c: str | Column, n: Column) -> Column:
    """Every integer of the text, from 1."""
    return _padded(_numbers(c, r"(\d+)"), n)


def parse_rank_swerank(c: str | Column, n: Column) -> Column:
    """(order, ok): bracketed numbers; with fewer than two, letters in brackets or before ``>``."""
    numbers, letters = _numbers(c, r"\[(\d+)\]"), F.transform(_all(_col(c), r"\[?\b([A-Z])\b\]?(?=\s*>|\])", 1), lambda x: F.ascii(x) - 65)
    own = F.when(F.size(F.array_distinct(numbers)) >= 2, numbers).otherwise(letters)
    return F.struct(_padded(own, n).alias("order"), (F.size(F.array_distinct(own)) >= 2).alias("ok"))


def parse_keywords(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(_col(c), r"[,;\n]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-+\s*|\s*-+$", ""))), lambda x: F.length(x) > 1)


def is_test_file(c: str | Column) -> Column:
    return _col(c).rlike(r"(?:^|/)(?:tests?|testing)/") | basename(c).rlike(r"^test_.*|_test\.py$|^conftest\.py$")


def is_test_loose(c: str | Column) -> Column:
    return F.lower(stem(c)).contains("test")


def is_junk_file(c: str | Column) -> Column:
    return (basename(c) == "conf.py") | _col(c).rlike("^docs?/") | _col(c).contains("makemigrations")


def test_pair(c: str | Column) -> Column:
    """Paths at which the test of a source, or the source of a test, would be."""
    d, s = dirname(c), stem(c)
    prefix = F.when(d == "", F.lit("")).otherwise(F.concat(d, F.lit("/")))
    up = F.regexp_replace(prefix, r"tests?/$", "")
    plain = F.regexp_replace(F.regexp_replace(s, "^test_", ""), "_test$", "")
    of_test = F.array(*(F.concat(p, plain, F.lit(".py")) for p in (prefix, up)))
    of_source = F.array(*(F.concat(prefix, F.lit(x), s, F.lit(y)) for x, y in (("test_", ".py"), ("tests/test_", ".py"), ("", "_test.py"), ("test/test_", ".py"))))
    return F.array_distinct(F.when(is_test_file(c), of_test).otherwise(of_source))


def stem_normalize(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem(c), "^tests?_", ""), "_tests?$", "")


def _dirs(c: str | Column) -> Column:
    d = dirname(c)
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.split(d, "/"))


def shared_prefix_depth(a: str | Column, b: str | Column) -> Column:
    """The number of leading directories in common."""
    same = F.zip_with(_dirs(a), _dirs(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def dir_distance_hops(a: str | Column, b: str | Column) -> Column:
    return F.size(_dirs(a)) + F.size(_dirs(b)) - 2 * shared_prefix_depth(a, b)


def dir_distance_class(a: str | Column, b: str | Column) -> Column:
    """0 same directory, 1 same parent, 2 same grandparent, else -1."""
    up = lambda c, n: dirname(c) if n == 0 else dirname(up(c, n - 1))
    return F.when(up(a, 0) == up(b, 0), 0).when(up(a, 1) == up(b, 1), 1).when(up(a, 2) == up(b, 2), 2).otherwise(-1)


def basename_similarity(a: str | Column, b: str | Column) -> Column:
    return F.when(basename(a) == basename(b), "same_name").when(stem_normalize(a) == stem_normalize(b), "test_variant").otherwise("different")


def edit_distance_component(a: str | Column, b: str | Column) -> Column:
    """Levenshtein over path components: each distinct component becomes one character."""
    both = F.array_distinct(F.concat(F.split(_col(a), "/"), F.split(_col(b), "/")))
    coded = lambda c: F.array_join(F.transform(F.split(_col(c), "/"), lambda x: F.char(F.array_position(both, x).cast("bigint") + 64)), "")
    return F.levenshtein(coded(a), coded(b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two token arrays as sets; 0 if one is empty, and as given if both are."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / n)


def coverage(issue: Column, path: Column) -> Column:
    """The share of the path's tokens that the issue has."""
    own = F.array_distinct(path)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, issue)) / F.size(own))


def lexical_overlap(text: Column, tokens: Column) -> Column:
    """The share of tokens that are substrings of the text."""
    own = F.array_distinct(tokens)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda t: F.lower(text).contains(t))) / F.size(own))


def overlap_log(issue: Column, path: Column) -> Column:
    own = _without(F.array_distinct(path), STOP)
    return F.size(F.array_intersect(own, _without(issue, STOP))) / (1 + F.ln(1.0 + F.size(own)))


def score_text_candidate(path: str | Column, paths: Column, names: Column, keywords: Column) -> Column:
    """Additive score of a candidate against the mentions of an issue; two keyword hits or more raise it by 1.3.

    An exact path counts 2, else each partial match 1; a base name 1.5; each keyword among the path's tokens 0.3.
    """
    c = _col(path)
    partial = F.size(F.filter(paths, lambda p: c.endswith(p) | p.endswith(c)))
    hits = F.size(F.array_intersect(F.array_distinct(tok_path_set(path)), keywords))
    base = F.when(F.array_contains(paths, c), 2.0).otherwise(partial * 1.0) + F.when(F.array_contains(names, basename(path)), 1.5).otherwise(0.0) + 0.3 * hits
    return base * F.when(hits >= 2, 1.3).otherwise(1.0)


def prompt_build(issue: Column, path: Column, code: Column, most_issue: int = 1500, most_code: int = 1500) -> Column:
    return F.concat(F.lit("Issue: "), F.left(issue, F.lit(most_issue)), F.lit("\nFile: "), path, F.lit("\nCode: "), F.left(code, F.lit(most_code)), F.lit("\nRelevant? "))


def truncate_suffix(body: Column, suffix: Column, most: int) -> Column:
    """At most so many tokens, of which the suffix is never cut."""
    return F.concat(F.slice(body, 1, F.greatest(F.lit(0), F.least(F.size(body), F.lit(most) - F.size(suffix)))), suffix)


def anonymous_name(c: str | Column) -> Column:
    """The path with its file name hashed; the last suffix stays (.py without one, or without a folder)."""
    name = basename(c)
    suffix = F.when(_col(c).contains("/") & name.rlike(r".\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(".py")
    return F.concat(F.left(_col(c), F.length(_col(c)) - F.length(name)), F.left(F.md5(name.cast("binary")), F.lit(8)), suffix)


def parse_rank_mixed(c: str | Column, candidates: str | Column) -> Column:
    """Places of the candidates (from 0) in the order that an answer gives them by number or path; the rest follow in old order.

    A first line with commas, or with numbers only, is the answer if it names two or more candidates; else each line is
    read, with or without a number in front. A path is that of the first candidate left that it equals or that ends with one another,
    or else has its file name; numbers count from 1. Numbers out of range, repeats and other words are passed over. Null answers: old order.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    among = F.coalesce(_col(candidates), F.array().cast("array<string>"))
    places = F.filter(F.sequence(F.lit(-1), F.size(among) - 1), lambda i: i >= 0)
    at = lambda i: F.get(among, i)

    def number(found, x):
        i = x.try_cast("int") - 1
        return F.when((i >= 0) & (i < F.size(among)) & ~F.array_contains(found, i), i)

    def path(found, x):
        x = strip(F.regexp_replace(strip(x), ",+$", ""))
        base = basename(F.regexp_replace(x, "/+$", ""))
        left = F.filter(places, lambda i: ~F.array_contains(found, i))
        whole = F.filter(left, lambda i: x.endswith(at(i)) | at(i).endswith(x))
        return F.coalesce(F.get(whole, F.lit(0)), F.get(F.filter(left, lambda i: (base != "") & (basename(at(i)) == base)), F.lit(0)))

    digits = lambda x: x.rlike("^[0-9]+$")
    add = lambda found, i: F.when(i.isNull(), found).otherwise(F.concat(found, F.array(i)))

    def line(found, x):
        content = strip(F.regexp_extract(x, r"^[0-9]+[.)]\s*(.+)$", 1))
        numbered = F.coalesce(path(found, content), F.when(digits(content), number(found, content)))
        return add(found, F.when(content != "", numbered).when(digits(x), number(found, x)).when(x != "", path(found, x)))

    lines = F.transform(F.split(strip(F.coalesce(_col(c), F.lit(""))), "\n"), strip)
    first, none = F.get(lines, F.lit(0)), F.array().cast("array<int>")
    tokens = F.when(F.contains(first, F.lit(",")), F.transform(F.split(first, ","), strip)).when(first.rlike(r"^[0-9]+(?:\s+[0-9]+)+$"), F.split(first, r"\s+")).otherwise(F.array().cast("array<string>"))
    short = F.aggregate(tokens, none, lambda found, x: add(found, F.when(digits(x), number(found, x)).otherwise(path(found, x))))
    order = F.when(F.size(short) >= 2, short).otherwise(F.aggregate(lines, none, line))
    return F.concat(order, F.array_except(places, order))
