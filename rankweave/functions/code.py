"""Python sources through the standard ``ast`` module: Arrow UDFs over a column of source text.

Parsing needs Python, so these are the engine's only row functions; each takes one column and gives an array of
structs, to be exploded. A source that doesn't parse gives the fallback that each rule names.
"""

from __future__ import annotations

import ast
import io
import tokenize

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<name: string, kind: string, start: int, end: int, docstring: string, code: string>>"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _parse(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def _walk(node: ast.AST, chain: tuple[str, ...] = ()):
    """(qualified name parts, node, whether its parent is a class) of every definition, outermost first."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (*_DEFS, ast.ClassDef)):
            own = (*chain, child.name)
            yield own, child, isinstance(node, ast.ClassDef)
            yield from _walk(child, own)
        else:
            yield from _walk(child, chain)


def entities(source: str | None, qualified: bool = False, class_lines: int = 30, whole_lines: int = 100) -> list[dict]:
    """Functions whole and classes up to some lines; if none parse, the whole file's first lines as one entity."""
    tree, lines, out = _parse(source), (source or "").split("\n"), []
    for chain, node, _ in _walk(tree) if tree else ():
        last = node.end_lineno if isinstance(node, _DEFS) else min(node.end_lineno, node.lineno + class_lines - 1)
        out.append({"name": ".".join(chain) if qualified else node.name, "kind": "function" if isinstance(node, _DEFS) else "class", "start": node.lineno, "end": node.end_lineno, "docstring": ast.get_docstring(node), "code": "\n".join(lines[node.lineno - 1 : last])})
    if not out and source:
        out.append({"name": "<file>", "kind": "file", "start": 1, "end": min(len(lines), whole_lines), "docstring": None, "code": "\n".join(lines[:whole_lines])})
    return out


def signatures(source: str | None) -> list[str]:
    """``def f(args):`` and ``class C(Base):`` of every definition."""
    tree = _parse(source)
    if tree is None:
        return []
    return [f"def {n.name}({ast.unparse(n.args)}):" if isinstance(n, _DEFS) else f"class {n.name}({', '.join(map(ast.unparse, n.bases))}):" if n.bases else f"class {n.name}:" for _, n, _ in _walk(tree)]


def corpus(source: str | None, path: str, extended: bool = False) -> list[dict]:
    """Function records ``path/Class/method``. Plain: methods of classes and functions whose name is no method's, no async.

    Extended: async and nested definitions too, by their whole chain.
    """
    tree = _parse(source)
    if tree is None:
        return []
    found = [(c, n, m) for c, n, m in _walk(tree) if isinstance(n, _DEFS)]
    methods = {n.name for _, n, m in found if m}
    lines, out, seen = (source or "").split("\n"), [], set()
    for chain, node, method in found:
        if not extended and (isinstance(node, ast.AsyncFunctionDef) or not method and node.name in methods):
            continue
        tail = "/".join(chain if extended else chain[-2:] if method else chain[-1:])
        if tail not in seen:
            seen.add(tail)
            out.append({"id": f"{path}/{tail}", "text": "\n".join(lines[node.lineno - 1 : node.end_lineno])})
    return out


def structure(source: str | None) -> dict:
    """Top-level imports (15 at most), classes with bases (10) and functions with methods (15); null if it doesn't parse."""
    tree = _parse(source)
    if tree is None:
        return {"imports": None, "classes": None, "functions": None}
    imports = [ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    classes = [f"{n.name}({', '.join(map(ast.unparse, n.bases))})" for n in tree.body if isinstance(n, ast.ClassDef)]
    functions = [".".join(c) for c, n, _ in _walk(tree) if isinstance(n, _DEFS)]
    return {"imports": imports[:15], "classes": classes[:10], "functions": functions[:15]}


def strip_comments(source: str | None) -> str | None:
    """The source without comments and docstrings; unchanged if it can't be tokenised or parsed."""
    if source is None:
        return None
    try:
        kept = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type != tokenize.COMMENT]
        tree = ast.parse(tokenize.untokenize(kept))
    except (tokenize.TokenError, SyntaxError, ValueError, RecursionError):
        return source
    for node in ast.walk(tree):
        if isinstance(node, (*_DEFS, ast.ClassDef, ast.Module)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:] or ([ast.Pass()] if not isinstance(node, ast.Module) else [])
    return ast.unparse(tree)


def identifiers(source: str | None) -> list[str]:
    """Names that the source defines or uses, in order of first use."""
    tree = _parse(source)
    if tree is None:
        return []
    names = (n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else n.name if isinstance(n, (*_DEFS, ast.ClassDef)) else n.arg if isinstance(n, ast.arg) else None for n in ast.walk(tree))
    return list(dict.fromkeys(x for x in names if x))


def longest_common_substring(a: str | None, b: str | None) -> int:
    a, b, best = a or "", b or "", 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else 0
            best = max(best, row[j])
    return best


def _udf(fn, kind: str):
    return F.udf(fn, kind, useArrow=True)


def ast_functions_flat(c: str | Column) -> Column:
    return _udf(lambda s: entities(s), ENTITY)(c)


def ast_functions_qual(c: str | Column) -> Column:
    return _udf(lambda s: entities(s, qualified=True), ENTITY)(c)


def ast_signatures(c: str | Column) -> Column:
    return _udf(signatures, "array<string>")(c)


def ast_corpus(c: str | Column, path: str | Column, extended: bool = False) -> Column:
    return _udf(lambda s, p: corpus(s, p, extended), "array<struct<id: string, text: string>>")(c, path)


def extract_structure(c: str | Column) -> Column:
    return _udf(structure, "struct<imports: array<string>, classes: array<string>, functions: array<string>>")(c)


def code_identifiers(c: str | Column) -> Column:
    return _udf(identifiers, "array<string>")(c)


def without_comments(c: str | Column) -> Column:
    return _udf(strip_comments, "string")(c)


def leaf_similarity(a: str | Column, b: str | Column) -> Column:
    """Longest common substring over the longer name's length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(_udf(longest_common_substring, "int")(a, b) / longest)
