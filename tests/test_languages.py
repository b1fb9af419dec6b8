"""Language helpers on hand-written sources."""

from factloom.functions import languages as L


def facts(found, kind):
    return [f for f in found if f["fact"] == kind]


def test_python_scopes_and_calls():
    src = (
        "import os, sys as s\nfrom a.b import c, d\nfrom . import e\nfrom x import *\nMAX = 10\n_p: int = 3\nlow = 1\n@dec(1)\n"
        "def f(a, b: int = 2, *c, d=None, **k) -> str:\n    '''doc'''\n    def inner():\n        return g(a)(b)\n    return inner\n"
        "class A(B, m.C):\n    K = 1\n    async def m(self):\n        self.x.y(1)\n"
    )
    out = L.python_facts(src)
    assert [(f["name"], f["module"]) for f in facts(out, "import")] == [
        ("os", ""), ("sys", ""), ("c", "a.b"), ("d", "a.b"), ("e", "."), ("*", "x")]
    assert [(f["name"], f["kind"], f.get("parent", "")) for f in facts(out, "symbol")] == [
        ("MAX", "variable", ""), ("_p", "variable", ""), ("f", "function", ""), ("inner", "method", "f"), ("A", "class", ""), ("m", "method", "A")]
    f = facts(out, "symbol")[2]
    assert (f["line"], f["return_type"], f["docstring"]) == (9, "str", "doc")
    assert [(p["name"], p["type"], p["default"]) for p in f["params"]] == [
        ("a", "", ""), ("b", "int", "2"), ("c", "", ""), ("d", "", "None"), ("k", "", "")]
    assert [(c["caller"], c["name"], c["line"]) for c in facts(out, "call")] == [
        ("<module>", "dec", 8), ("f.inner", "g(a)", 12), ("f.inner", "g", 12), ("A.m", "self.x.y", 17)]
    assert facts(out, "symbol")[4]["signature"] == "class A(B)"


def test_c_scopes():
    src = (
        '#include <a.h>\n# include "b.h"\n#define M(x) foo(x); {\nstruct S { int n; int (*cb)(int); };\n/* f(1) { */\n'
        "static char *name(struct S *p, int n)\n{\n  if (n > 0) { p->cb(n); }\n  for (int i = 0; i < n; i++) loop(i);\n  return \"g(\" ? h(n) : 0;\n}\n"
        "namespace z { class B : public C { public: B() : x(1) {} void m(int q) const { ns::g(q); } private: int x; }; }\nint proto(int);\n"
    )
    out = L.c_facts(src)
    assert [f["name"] for f in facts(out, "import")] == ["<a.h>", '"b.h"']
    assert [(f["name"], f["kind"], f["parent"]) for f in facts(out, "symbol")] == [
        ("S", "struct", ""), ("n", "variable", "S"), ("(*cb)(int)", "variable", "S"), ("name", "function", ""),
        ("B", "class", ""), ("B", "function", "B"), ("m", "function", "B"), ("x", "variable", "B")]
    name = facts(out, "symbol")[3]
    assert (name["line"], name["end_line"], name["return_type"]) == (6, 11, "char")
    assert [(c["caller"], c["name"]) for c in facts(out, "call")] == [
        ("name", "p->cb"), ("name", "loop"), ("name", "h"), ("B::m", "ns::g")]


def test_java_scopes():
    src = (
        "import java.util.List;\nimport static a.B.c;\n@X(\"y\")\npublic class A<T> extends B<T> implements C, D<E, F> {\n"
        "  private int n = init(3), m;\n  A(int q) { setup(q); }\n  public static <R> int f(int a, String[] s, List<T> l) throws E {\n"
        "    return this.g(a).h(new Z(1));\n  }\n  abstract void t();\n  interface I { void u(); }\n}\n"
    )
    out = L.java_facts(src)
    assert [f["name"] for f in facts(out, "import")] == ["java.util.List", "a.B.c"]
    assert [(f["name"], f["kind"], f["parent"], f["line"]) for f in facts(out, "symbol")] == [
        ("A", "class", "", 3), ("n", "variable", "A", 5), ("m", "variable", "A", 5), ("f", "method", "A", 7),
        ("t", "method", "A", 10), ("I", "interface", "A", 11), ("u", "method", "A.I", 11)]
    f = facts(out, "symbol")[3]
    assert [p["type"] for p in f["params"]] == ["int", "", "List<T>"] and f["is_static"] and f["visibility"] == "public"
    assert [(c["caller"], c["name"]) for c in facts(out, "call")] == [
        ("A", "init"), ("A", "setup"), ("A.f", "this.g"), ("A.f", "this.g(a).h")]


def test_scala_scopes():
    src = (
        "import a.b.{C, D}\nobject O extends App {\n  def f(x: Int): Int = {\n    val y = g(x)\n    y.map(h)\n  }\n  def s(a: Int) = t(a)\n"
        "  case class P(x: Int)\n}\ntrait T { def u: Int }\n"
    )
    out = L.scala_facts(src)
    assert [f["name"] for f in facts(out, "import")] == ["a.b.{C, D}"]
    assert [(f["name"], f["kind"], f["parent"], f["line"], f["end_line"]) for f in facts(out, "symbol")] == [
        ("O", "object", "", 2, 9), ("f", "method", "O", 3, 6), ("s", "method", "O", 7, 7), ("P", "class", "O", 8, 8),
        ("T", "trait", "", 10, 10), ("u", "method", "T", 10, 10)]
    assert [(c["caller"], c["name"]) for c in facts(out, "call")] == [("O.f", "g"), ("O.f", "y.map"), ("O.s", "t")]


def test_xml_elements_and_sql():
    src = '<?xml version="1.0"?>\n<a x="é" y=\'2\'>\n<b>select upper(c) from  tttt where x</b><c/>\n<d>drop table x</d></a>'
    out = L.xml_facts(src)
    assert [(f["name"], f["kind"], f["parent"], f["line"]) for f in out] == [
        ("a", "xml_element", "", 2), ("b", "xml_element", "a", 3), ("SQL_b_3", "sql_in_xml", "a/b", 3), ("d", "xml_element", "a", 4)]
    assert out[0]["signature"] == "<a x=é, y=2>" and out[0]["end_line"] == 4


def test_links_and_spaces():
    from factloom.functions import languages as L

    calls = lambda facts: [f["name"] for f in facts if f["fact"] == "call"]
    assert calls(L.java_facts("class A { void m() { xs.map(x -> h(x)); a" + " " * 200 + ".b(); } }")) == ["xs.map", "h", "a" + " " * 200 + ".b"]
    assert calls(L.scala_facts("object A { def m() = { p -> h(x) } }")) == ["h"]
    assert calls(L.c_facts("void f() { p->q->run(1); }")) == ["p->q->run"]


def test_facts_before_a_fault_stay():
    from factloom.functions import languages as L

    found = L.xml_facts("<a><b>x</b><c></a>")
    assert [f["name"] for f in found if f["fact"] == "symbol"] == ["a", "b", "c"] and [f["fact"] for f in found][-1] == "error"
