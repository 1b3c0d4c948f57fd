"""Rewriting of sources against walks over the text with Python's own patterns."""

import hashlib
import re

from pyspark.sql import functions as F

from rankweave.operators import rewrite as w


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()[:16]


def module(x):
    parts = [p for p in x.lower().split(".") if p]
    return f"d_{h(parts[0])}" if len(parts) == 1 else ".".join([f"d_{h(p)}" for p in parts[:-1]] + [f"m_{h(parts[-1] + '.py')}"])


def words(text, roots):
    """One pattern with guards on both sides, replaced in place."""

    def one(m):
        run = m.group(0)
        sep = "/" if "/" in run else "."
        if run.split(sep)[0].lower() not in roots:
            return run
        if sep == ".":
            return module(run)
        parts = run.lower().strip("/").split("/")
        leaf = f"m_{h(parts[-1])}.py" if parts[-1].endswith(".py") else f"d_{h(parts[-1])}"
        return "/".join([f"d_{h(p)}" for p in parts[:-1]] + [leaf]) + ("/" if run.endswith("/") else "")

    name, guard = r"[A-Za-z_][A-Za-z0-9_]*", r"[A-Za-z0-9_./-]"
    part = r"[A-Za-z_][A-Za-z0-9_-]*(?:/[A-Za-z0-9_][A-Za-z0-9_.-]*)+"
    return re.sub(rf"(?<!{guard})(?:{part}(?:\.py|/)|{name}(?:\.{name})+)(?!{guard})", one, text)


def table(spark, texts, roots=("pkg", "core")):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("roots", F.array(*map(F.lit, roots)))


def test_words(spark):
    texts = ["see pkg/a.py, core/x/ and pkg.mod.fn", "https://pkg/a.py (pkg/a.py). pkg/a.py.", "PKG/A.py core.X; os.path json/x.py other/a.py", "", "pkg", "pkg..x .pkg.a -pkg.a", "é pkg.b é\n\tcore/p-q/r.v.py\n", None, "x" * 50_000 + " pkg.a " * 2_000]
    found = [r[0] for r in table(spark, texts).repartition(3).select("i", w.clean_words("text", "roots").alias("o")).orderBy("i").select("o").collect()]
    assert found == [x if x is None else words(x, {"pkg", "core"}) for x in texts]
    assert found[0] == f"see d_{h('pkg')}/m_{h('a.py')}.py, d_{h('core')}/d_{h('x')}/ and d_{h('pkg')}.d_{h('mod')}.m_{h('fn.py')}"


def test_imports(spark):
    texts = ["from pkg.a import b  # c\nx = 1\n", "  import os, core.b as c , json\n", "import pkg", "from . import pkg\nfrom os import path\nimport otherpkg", "import pkg.a,core\n", "important pkg.a", None, "", "from pkg.a import b\r\nimport core\r\n"]
    found = [r[0] for r in table(spark, texts).select("i", w.clean_imports("text", "roots").alias("o")).orderBy("i").select("o").collect()]
    a, core, b = module("pkg.a"), module("core"), module("core.b")
    assert found == [f"from {a} import b  # c\nx = 1\n", f"  import os, {b} as c, json\n", f"import {module('pkg')}", texts[3], f"import {a},{core}\n", texts[5], None, "", f"from {a} import b\r\nimport {core}\r\n"]


def test_source(spark):
    a = module("pkg.a")
    cases = {
        "x = pkg.a # pkg.a\n": f"x = pkg.a # {a}\n",
        "y = 'pkg.a' + pkg.a": f"y = '{a}' + pkg.a",
        'z = "\\" pkg.a" + pkg.a': f'z = "\\" {a}" + pkg.a',
        'z = "\\\\" + pkg.a': 'z = "\\\\" + pkg.a',
        '"""\nit\'s pkg.a "\n""" + pkg.a': f'"""\nit\'s {a} "\n""" + pkg.a',
        "don't pkg.a\n# 'pkg.a": f"don't pkg.a\n# '{a}",
        "import pkg.a\ns = ''\nt = '# pkg.a'": f"import {a}\ns = ''\nt = '# {a}'",
        "'''''' pkg.a ''": "'''''' pkg.a ''",
        "'" + "\\'" * 20_000 + " pkg.a '": "'" + "\\'" * 20_000 + f" {a} '",
    }
    found = {r["text"]: r["o"] for r in table(spark, list(cases)).select("text", w.clean_source("text", "roots").alias("o")).collect()}
    assert found == cases


def test_roots(spark):
    rows = [("own__my-lib", "src/mylib/a.py"), ("own__my-lib", "Docs/x.py"), ("own__json", "setup.py"), ("own__json", "/lib/")]
    found = {r["repo"]: r["roots"] for r in w.repo_roots(spark.createDataFrame(rows, "repo string, path string")).collect()}
    assert found == {"own__my-lib": ["docs", "my-lib", "my_lib", "mylib", "src"], "own__json": ["lib", "setup.py"]}


def test_functions(spark):
    f, c, m = f"f_{h('FUNC::run')}", f"C_{h('CLASS::A')}", f"m_{h('METHOD::A::run')}"
    x = f"X_{h('XCLASS::A')}/X_{h('XCLASS::A::B')}/m_{h('XMETHOD::A::B::run')}"
    cases = [
        ("p/a.py/run", "def other():\n  pass\ndef run (x):\n  def run(): 1", f"p/a.py/{f}", f"def other():\n  pass\ndef {f} (x):\n  def run(): 1", "main", True),
        ("p/a.py/run", "p/a.py/run\ndef run():", f"p/a.py/{f}", f"p/a.py/{f}\ndef {f}():", "main", True),
        ("p/a.py/A/run", "\nclass A(B):    def run(self): 0", f"p/a.py/{c}/{m}", f"\nclass {c}(B):    def {m}(self): 0", "main", True),
        ("p/a.py/A/run", "class Other:    def run(self):\n  def run():", f"p/a.py/{c}/{m}", f"class Other:    def run(self):\n  def {m}():", "fallback", True),
        ("p/a.py/A/B/run", "def run():", f"p/a.py/{x}", f"def {x.split('/')[-1]}():", "main", True),
        ("p/a.py/run", "def runs():\nrun()", f"p/a.py/{f}", "def runs():\nrun()", "miss", None),
        ("p/a.py", "def run():", "p/a.py", "def run():", "noop", None),
        ("p/a.py/A/run", None, f"p/a.py/{c}/{m}", "", "miss", None),
        (None, "def run():", None, "def run():", "noop", None),
        ("p/a.py/é", "def é():", f"p/a.py/f_{h('FUNC::é')}", "def é():", "miss", None),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, item string, body string").repartition(3)
    found = w.swap_functions(rows).orderBy("i").collect()
    assert [(r["item"], r["body"], r["new_id"], r["new_body"], r["status"], r["audited"]) for r in found] == cases
