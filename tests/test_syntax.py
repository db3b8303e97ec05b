"""Declarations of each language that has a splitter."""

import pytest

from lodestrand.operators.syntax import spans, syntax_chunks

CASES = {
    "python": ("X = 1\n@a\ndef f():\n    def g(): pass\n\nclass C:\n    def m(self): ...\nif X:\n    async def h():\n        return 1\n", ["@a\ndef f():\n    def g(): pass", "class C:\n    def m(self): ...", "async def h():\n        return 1"]),
    "rust": ("\nfn hello() {\n  println!(\"}\");\n}\n\npub fn bye() {\n}\n// fn no() {}\nconst X: u8 = 1;\nimpl T { fn a(&self) {} }\nstruct S;\nmacro_rules! m { () => {} }\n", ['fn hello() {\n  println!("}");\n}', "pub fn bye() {\n}", "impl T { fn a(&self) {} }", "struct S;", "macro_rules! m { () => {} }"]),
    "javascript": ("const f = (a) => { return a; };\nfunction g() {}\nclass A { m() {} }\nexport const q = 1;\n", ["(a) => { return a; }", "function g() {}", "class A { m() {} }", "export const q = 1;"]),
    "typescript": ("interface P { a: string }\ntype Q = { a: 1 } | string;\nfunction id<T>(x: T): T { return x; }\n", ["interface P { a: string }", "type Q = { a: 1 } | string;", "function id<T>(x: T): T { return x; }"]),
    "tsx": ("function App() { return <div/>; }\n", ["function App() { return <div/>; }"]),
    "go": ("package m\ntype P struct {\n a int\n}\nfunc (p *P) M() int { return 1 }\n", ["type P struct {\n a int\n}", "func (p *P) M() int { return 1 }"]),
    "java": ("import b.C;\n@Old\npublic class A {\n int f() { return 1; }\n}\ninterface I { void x(); }\n", ["@Old\npublic class A {\n int f() { return 1; }\n}", "interface I { void x(); }"]),
    "c": ("int add(int a);\nstatic int add(int a) {\n  if (a) { return 1; }\n  return a;\n}\nstruct P { int x; };\n", ["static int add(int a) {\n  if (a) { return 1; }\n  return a;\n}", "struct P { int x; }"]),
    "cpp": ("namespace n {\nint f() { return 1; }\n}\ntemplate <typename T>\nT id(T x) { return x; }\nvoid A::g() const { }\n", ["namespace n {\nint f() { return 1; }\n}", "template <typename T>\nT id(T x) { return x; }", "void A::g() const { }"]),
    "php": ("<?php\nfunction a($x) { return '}'; }\nfinal class B { function c() {} }\n", ["function a($x) { return '}'; }", "final class B { function c() {} }"]),
    "swift": ("func a() -> Int { return 1 }\nstruct B { var x: Int }\n", ["func a() -> Int { return 1 }", "struct B { var x: Int }"]),
    "scala": ("object A {\n def b = 1\n}\ncase class D(y: Int)\n", ["object A {\n def b = 1\n}", "case class D(y: Int)"]),
    "csharp": ("namespace N {\n public class A { void M() {} }\n struct S {}\n}\n", ["public class A { void M() {} }", "struct S {}"]),
    "ruby": ("def a\nend\n", []),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_outermost_declarations(language):
    source, want = CASES[language]
    assert [source[a:b] for a, b in spans(source, language)] == want


def test_no_declaration_and_broken_source():
    assert spans("const X: u8 = 1;\n", "rust") == [] and spans("x = 1\n", "python") == [] and spans("anything", "kotlin") == []
    broken = "def f(:\n    x = 1\n\n@a\ndef ok():\n    return (\n\ny = 2\n"
    assert [broken[a:b] for a, b in spans(broken, "python")] == ["def f(:\n    x = 1", "@a\ndef ok():\n    return ("]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("Des " * 20_000 + "\n\ndef f():\n    return 1\n", ["def f():\n    return 1"]),
        ("x = " + " + ".join(["1"] * 3000) + "\n\n\ndef f():\n    return 1\n", ["def f():\n    return 1"]),
        ("x = 1\rdef f():\r    return 'é'\r\rclass A:\r    pass\r", ["def f():\r    return 'é'", "class A:\r    pass"]),
        ("x = 1\r\n@d\r\ndef f():\r\n    return 'é'; y = 2\r\n", ["@d\r\ndef f():\r\n    return 'é'; y = 2"]),
    ],
    ids=["parser stack", "deep tree", "carriage returns", "both"],
)
def test_python_that_parser_or_walk_cannot_take(source, want):
    assert [source[a:b] for a, b in spans(source, "python")] == want


def test_chunks(spark):
    rows = [("s.rs", "\nfn hello() {\n}\n\nfn bye() {\n}\n"), ("e.rs", ""), ("n.rs", None), ("x.txt", "fn a() {}")]
    got = syntax_chunks(spark.createDataFrame(rows, "relative_path string, content string")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.content) for r in got] == [(2, 3, "fn hello() {\n}"), (5, 6, "fn bye() {\n}")]
    assert all(len(r.chunk_id) == 64 for r in got) and got[0].chunk_id != got[1].chunk_id
