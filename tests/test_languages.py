"""Parsers against small sources whose rows are known."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.sources.languages import language_of, module_of, parse
from sparkloom.sources.languages.python import absolute_module, parse_python
from sparkloom.sources.repository import listing


def symbols(p):
    return [(s[1], s[2], s[3], s[4], s[5]) for s in p.symbols]


def calls(p):
    return [(c[0], c[1], c[2], c[3]) for c in p.calls]


def test_python_symbols_imports_and_calls():
    source = b"""import a.b as c
from . import x
from ..m import y as z
from k import *
from __future__ import annotations
def f(q=g()):
    return h(q).i(j())
class A:
    def m(self):
        def inner():
            deep()
        self.f(A.g())
    class B:
        pass
@dec
def left_out():
    pass
if True:
    def hidden(): pass
async def co():
    await f()
"""
    p = parse(source, "pkg/sub/mod.py")
    assert symbols(p) == [("function", "f", 6, 7, None), ("class", "A", 8, 14, None), ("method", "A.m", 9, 12, "A"), ("class", "A.B", 13, 14, "A"), ("function", "co", 20, 21, None)]
    assert p.imports == [("a.b", "a.b", "c", False), ("pkg.sub.x", "x", None, True), ("pkg.m", "y", "z", True), ("k", "*", None, True)]
    assert calls(p) == [("f", "i", "h(q).i", 7), ("f", "h", "h", 7), ("f", "j", "j", 7), ("A.m", "deep", "deep", 11), ("A.m", "f", "self.f", 12), ("A.m", "g", "A.g", 12), ("co", "f", "f", 21)]
    assert ("function", "left_out", 16, 17, None) in symbols(parse_python(source, "pkg/sub/mod.py", decorated=True))


def test_python_oddities():
    assert (parse(b"def f(:", "a.py").status, parse(b"((", "a.py").status) == ("partial", "error")
    assert parse(b"", "a.py").symbols == []
    assert symbols(parse("def ä():\n    ö('é').ü()\n".encode(), "a.py")) == [("function", "ä", 1, 2, None)]
    assert calls(parse("def ä():\n    ö('é').ü()\n".encode(), "a.py"))[0] == ("ä", "ü", "ö('é').ü", 2)
    assert parse(b"x = '\xff'\r\ndef f():\r\n    g()\r\n", "a.py").calls == [("f", "g", "g", 3)]
    assert absolute_module("p/__init__.py", 1, "q") == "p.q"
    assert absolute_module("p/r.py", 2, "") == ""
    assert absolute_module("r.py", 1, "q") == "q"


def test_modules_and_languages():
    assert [module_of(x) for x in ("a/b.py", "a/__init__.py", "__init__.py", "w/u.tsx", "src/com/x/Main.java", "a/x.min.js")] == ["a.b", "a", "", "w.u", "src.com.x.Main", "a.x.min"]
    assert [language_of(x) for x in ("a.py", "a.mjs", "a.ts", "a.tsx", "A.java", "a.PY", "Makefile")] == ["python", "js", "ts", "tsx", "java", None, None]


def test_script():
    source = b"""import def, { a as b, c } from './util';
import './style.css';
export async function greet(n: string): Promise<void> { const r = /a"b/; x(`t ${y(1)} z`); new Foo(bar()); return a.b?.c(d()); }
const f = (x) => g(x), k = 3
export const h = async function () { i().j(); };
class A extends B { static async m(x) { return this.n(x) } n = () => q(); get v() { return w() } constructor(){ super(1) } }
export interface I { a(): void }
let o = { p() { z() } }
export default function main() { greet() }
function* gen() { no() }
"""
    p = parse(source, "web/types.ts")
    assert [s[:2] for s in symbols(p)] == [("function", "greet"), ("function", "f"), ("function", "h"), ("class", "A"), ("method", "A.m"), ("method", "A.v"), ("method", "A.constructor"), ("class", "I"), ("function", "main")]
    assert p.imports == [("web.util", "def", None, True), ("web.util", "a", "b", True), ("web.util", "c", None, True), ("web.style.css", "*", None, True)]
    assert [(c[0], c[2]) for c in calls(p)] == [("greet", "x"), ("greet", "y"), ("greet", "bar"), ("greet", "a.b?.c"), ("greet", "d"), ("f", "g"), ("h", "i().j"), ("h", "i"), ("A.m", "this.n"), ("A.v", "w"), ("A.constructor", "super"), ("main", "greet")]


def test_java():
    source = b"""package com.x; import com.y.Z; import static a.b.C.d; import single;
public class Main { private int k = foo(); static { bar(); }
 @Override public <T> void run(Z z) throws E { z.f(); new Q(r()).s(); this.t().u(1); if (a(b())) {} }
 Main() { super(); init(); }
 class In { void no() { c(); } }
 abstract int abs(int x);
}
interface J { void k(); }
"""
    p = parse(source, "src/com/x/Main.java")
    assert [s[:2] for s in symbols(p)] == [("class", "Main"), ("method", "Main.run"), ("method", "Main.Main"), ("method", "Main.abs"), ("class", "J")]
    assert p.imports == [("com.y", "Z", None, False), ("a.b.C", "d", None, False)]
    assert [c[2] for c in calls(p)] == ["z.f", "new Q(r()).s", "r", "this.t().u", "this.t", "a", "b", "init"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(){}[];,.:=<>'\"`$/*\\ \nfunctioclsxp1", max_size=60), st.sampled_from(["a.js", "a.ts", "A.java", "a.py"]))
def test_any_text_is_parsed(text, path):
    p = parse(text.encode(), path)
    assert all(s[3] <= s[4] for s in p.symbols)


def test_discovery(tmp_path):
    for name in ("__init__.py", "_u.py", ".hidden.py", "_priv/u.py", ".git/x.py", "a/b.ts", "a/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(listing(str(tmp_path))) == ["__init__.py", "_priv/u.py", "_u.py", "a/b.ts"]
