"""Per-file fact helpers for the Python workers: text in, list of fact dicts out.

Python and XML use the parsers of the standard library. C, C++, Java and Scala
share one brace scanner: comments and literals are blanked, declarations are
found by their heads, and scopes by matching braces.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable
from typing import get_args
from xml.parsers import expat

from factloom.fixed_values import SQL_VERBS_XML

CHARS_SIGNATURE = 300
CHARS_VALUE = 200
CHARS_DEFAULT = 100


def symbol(name: str, kind: str, line: int, end_line: int, **rest) -> dict:
    return {"fact": "symbol", "name": name, "kind": kind, "line": line, "end_line": end_line, **rest}


def edge(caller: str, callee: str, line: int) -> dict:
    return {"fact": "call", "name": callee, "caller": caller, "line": line}


def imported(source: str, line: int, module: str = "") -> dict:
    return {"fact": "import", "name": source, "line": line, "module": module}


# Python -----------------------------------------------------------------

# nodes without a call, definition, import or assignment below them
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.alias, ast.Pass)


def _below(cls: type) -> list[type]:
    return [cls, *(c for sub in cls.__subclasses__() for c in _below(sub))]


# columns of a Python symbol that take work beyond its name, place and head
_LONG = ("return_type", "params", "docstring")


class _PythonFacts:
    def __init__(self, source: str, wanted: frozenset[str] | None = None):
        # columns count bytes; of an ASCII text those are its characters, and its names are what it says
        self.ascii = source.isascii()
        self.lines = source.split("\n") if self.ascii else source.encode("utf-8").split(b"\n")
        self.scope = ""
        self.out: list[dict] = []
        self.imports = wanted is None or "import" in wanted
        self.whole = wanted is None or not wanted.isdisjoint(_LONG)
        self.calls = wanted is None or "call" in wanted

    def visit(self, node: ast.AST) -> None:
        handler = _HANDLERS.get(node.__class__)
        if handler:
            handler(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for field in _CHILDREN[node.__class__]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                for item in value:
                    # leaves and plain values have no handler
                    handler = _HANDLERS.get(item.__class__)
                    if handler:
                        handler(self, item)
            elif value is not None:
                handler = _HANDLERS.get(value.__class__)
                if handler:
                    handler(self, value)

    def only_value(self, node: ast.AST) -> None:
        """A node whose value alone may hold others."""
        handler = _HANDLERS.get(node.value.__class__)
        if handler:
            handler(self, node.value)

    visit_Attribute = visit_Expr = visit_Return = visit_keyword = only_value

    def visit_arguments(self, node: ast.arguments) -> None:
        for args in (node.posonlyargs, node.args, (node.vararg,), node.kwonlyargs, node.kw_defaults, (node.kwarg,), node.defaults):
            for item in args:
                if item.__class__ is ast.arg:
                    item = item.annotation
                handler = _HANDLERS.get(item.__class__)
                if handler:
                    handler(self, item)

    def text(self, node: ast.AST) -> str:
        if self.ascii:
            if node.__class__ is ast.Name:
                return node.id
            if node.lineno == node.end_lineno:
                return self.lines[node.lineno - 1][node.col_offset:node.end_col_offset]
            first, last = node.lineno - 1, node.end_lineno - 1
            return "\n".join([self.lines[first][node.col_offset:], *self.lines[first + 1:last], self.lines[last][:node.end_col_offset]])
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset:node.end_col_offset].decode("utf-8")
        middle = self.lines[first + 1:last]
        parts = [self.lines[first][node.col_offset:], *middle, self.lines[last][:node.end_col_offset]]
        return b"\n".join(parts).decode("utf-8")

    def inside(self, name: str, nodes: list) -> None:
        outer, self.scope = self.scope, f"{self.scope}.{name}" if self.scope else name
        for node in nodes:
            self.visit(node)
        self.scope = outer

    def params(self, args: ast.arguments) -> list[dict]:
        plain = args.posonlyargs + args.args
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        pairs = list(zip(plain, defaults))
        if args.vararg:
            pairs.append((args.vararg, None))
        pairs += list(zip(args.kwonlyargs, args.kw_defaults))
        if args.kwarg:
            pairs.append((args.kwarg, None))
        return [
            {
                "name": a.arg,
                "type": self.text(a.annotation) if a.annotation else "",
                "default": self.text(d)[:CHARS_DEFAULT] if d else "",
            }
            for a, d in pairs
        ]

    def visit_FunctionDef(self, node) -> None:
        for decorator in node.decorator_list:
            self.visit(decorator)
        kind = "method" if self.scope else "function"
        signature = self.lines[node.lineno - 1][node.col_offset:]
        found = symbol(node.name, kind, node.lineno, node.end_lineno, signature=signature if self.ascii else signature.decode("utf-8"), parent=self.scope)
        if self.whole:
            found["return_type"] = self.text(node.returns) if node.returns else ""
            found["params"] = self.params(node.args)
            found["docstring"] = (ast.get_docstring(node, clean=False) or "").strip()
        self.out.append(found)
        self.inside(node.name, [node.args, *([node.returns] if node.returns else []), *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for decorator in node.decorator_list:
            self.visit(decorator)
        bases = ", ".join(b.id for b in node.bases if isinstance(b, ast.Name))
        self.out.append(symbol(
            node.name, "class", node.lineno, node.end_lineno,
            signature=f"class {node.name}" + (f"({bases})" if bases else ""),
            docstring=(ast.get_docstring(node, clean=False) or "").strip() if self.whole else "", parent=self.scope,
        ))
        self.inside(node.name, [*node.bases, *node.keywords, *node.body])

    def visit_Import(self, node: ast.Import) -> None:
        if self.imports:
            self.out += [imported(a.name, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if self.imports:
            module = "." * node.level + (node.module or "")
            self.out += [imported(a.name, node.lineno, module) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        func = node.func
        if self.calls:
            self.out.append(edge(self.scope or "<module>", self.text(func), node.lineno))
        handler = _HANDLERS.get(func.__class__)
        if handler:
            handler(self, func)
        for item in node.args:
            handler = _HANDLERS.get(item.__class__)
            if handler:
                handler(self, item)
        for word in node.keywords:
            handler = _HANDLERS.get(word.value.__class__)
            if handler:
                handler(self, word.value)

    def constant(self, node, targets: list) -> None:
        for target in targets if not self.scope else []:
            if isinstance(target, ast.Name) and (target.id.isupper() or target.id.startswith("_")):
                value = self.text(node.value)[:CHARS_VALUE] if node.value else ""
                self.out.append(symbol(
                    target.id, "variable", node.lineno, node.end_lineno, signature=f"{target.id} = {value}"
                ))
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.constant(node, node.targets)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.constant(node, [node.target])


def _children(cls: type) -> tuple[str, ...]:
    """The fields that may hold nodes with a handler, in order; all of them where Python does not tell their types."""
    types = getattr(cls, "_field_types", None)
    if types is None:
        return tuple(cls._fields)
    # list[expr] and expr | None hold what their arguments name
    held = {f: get_args(types.get(f)) or (types.get(f),) for f in cls._fields}
    return tuple(f for f in cls._fields if any(t is None or issubclass(t, ast.AST) and not issubclass(t, _LEAVES) for t in held[f]))


_CHILDREN = {c: _children(c) for c in _below(ast.AST)}
# what to do with a node, by its class; one look-up in place of a name made for every node
_HANDLERS = {
    c: getattr(_PythonFacts, f"visit_{c.__name__}", _PythonFacts.generic_visit) for c in _below(ast.AST) if not issubclass(c, _LEAVES)
}


def python_facts(source: str, wanted: frozenset[str] | None = None) -> list[dict]:
    """``wanted``: the kinds of facts and the columns that a reader takes; others may be left out."""
    # line ends that the parser counts and the text below does not are an error in any case
    visitor = _PythonFacts(source, None if "\r" in source else wanted)
    visitor.visit(ast.parse(source))
    return visitor.out


# XML --------------------------------------------------------------------

def xml_facts(source: str) -> list[dict]:
    """Elements with a start tag; SQL in their text as a second symbol.

    The whole SQL text goes out in ``docstring`` for the SQL operators.
    """
    data = source.encode("utf-8")
    parser = expat.ParserCreate("utf-8")
    out: list[dict] = []
    open_tags: list[dict] = []

    def start(name: str, attrs: dict) -> None:
        path = f"{open_tags[-1]['path']}/{name}" if open_tags else name
        shown = ", ".join(f"{k}={v}" for k, v in attrs.items())
        fact = symbol(
            name, "xml_element", parser.CurrentLineNumber, 0,
            signature=(f"<{name} {shown}>" if shown else f"<{name}>")[:500],
            parent=open_tags[-1]["path"] if open_tags else "",
        )
        out.append(fact)
        slot = len(out)
        out.append({})
        open_tags.append({"path": path, "fact": fact, "slot": slot, "text": []})

    def chars(data: str) -> None:
        if open_tags:
            open_tags[-1]["text"].append(data)

    def end(name: str) -> None:
        tag = open_tags.pop()
        fact = tag["fact"]
        if not data.startswith(b"</", parser.CurrentByteIndex):  # <a/> has no start tag
            fact.clear()
            return
        fact["end_line"] = parser.CurrentLineNumber
        text = "".join(tag["text"]).strip()
        if len(text) > 20 and text.split()[0].upper() in SQL_VERBS_XML:
            out[tag["slot"]] = symbol(
                f"SQL_{name}_{fact['line']}", "sql_in_xml", fact["line"], fact["end_line"],
                signature=text[:500], docstring=text, parent=tag["path"],
            )

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        parser.Parse(data, True)
    except expat.ExpatError as error:  # what was read before the fault stays
        out.append({"fact": "error", "name": f"extract error: {error}"})
    return [f for f in out if f]


# brace languages ----------------------------------------------------------

_LITERAL = re.compile(
    r'//[^\n]*|/\*.*?\*/|"""(?:.*?)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'', re.S
)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.M)
_BLANK = re.compile(r"[^\n]")
_NAMED_CALL = re.compile(r"[A-Za-z_$~][\w$]*(?=\s*\()")
# member links before a name; only C and C++ have the arrow
_LINK = {True: re.compile(r"(?:\.|->|::)\s*$"), False: re.compile(r"(?:\.|::)\s*$")}
# Words before a parenthesis that are no calls.
_NO_CALL = {
    "if", "for", "while", "switch", "catch", "return", "sizeof", "synchronized", "super", "this",
    "match", "case", "else", "do", "try", "throw", "new", "assert", "yield", "def", "defined",
    "alignof", "decltype", "int", "void", "char", "long", "short", "float", "double", "bool", "with",
}
_CONTROL = re.compile(r"(?:if|else|for|while|switch|do|try|catch|finally|return|synchronized|case|default)\b")
_MODIFIER = re.compile(r"\b(?:static|inline|extern|const|constexpr|virtual|explicit|friend|register|volatile|typedef|template\s*<[^>]*>)\b")
_LABEL = re.compile(r"^\s*(?:public|private|protected|signals|slots)\s*:(?!:)")


def _blank(match: re.Match) -> str:
    return _BLANK.sub(" ", match.group())


def _split_params(text: str) -> list[str]:
    parts, level, start = [], 0, 0
    for i, c in enumerate(text):
        level += (c in "(<[{") - (c in ")>]}")
        if c == "," and level <= 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [" ".join(p.split()) for p in parts if p.strip()]


def _c_declared(text: str) -> tuple[str, str]:
    """Type and declarator of a C declaration without initialiser."""
    text = " ".join(_MODIFIER.sub(" ", text).split())
    m = re.match(r"((?:struct|enum|union|class|unsigned|signed|long|short)\s+(?:\w+)|[\w:]+(?:<.*>)?)\s*(.*)$", text, re.S)
    return (m.group(1), m.group(2).strip()) if m else (text, "")


def _c_head(head: str) -> dict | None:
    m = re.match(r"^(?:typedef\s+)?(?:template\s*<[^>]*>\s*)?(class|struct)\s+(\w+)[^()=]*$", head)
    if m:
        return {"name": m.group(2), "kind": m.group(1)}
    head = re.sub(r"\)\s*:(?!:).*$", ")", head, flags=re.S)  # member initialisers
    m = re.match(r"^([^()={}]*?)([\w:~]+|operator\s*\S+)\s*\(([^{}]*)\)\s*(?:const|noexcept|override|final|throw\s*\(\s*\)|\s|:.*)*$", head, re.S)
    if not m or "=" in m.group(1):
        return None
    declared = [_c_declared(p) for p in _split_params(m.group(3))]
    return {
        "name": m.group(2).strip("*& "), "kind": "function", "return_type": _c_declared(m.group(1).replace("*", " ").replace("&", " "))[0],
        "params": [{"name": d.split("=")[0].strip(), "type": t, "default": ""} for t, d in declared],
    }


def _java_type(text: str) -> str:
    return text if re.match(r"^[A-Za-z_]\w*(?:<.*>)?$", text) and text not in ("float", "double") else ""


def _java_head(head: str) -> dict | None:
    plain = re.sub(r"@\w[\w.]*(?:\s*\([^)]*\))?", " ", head)
    m = re.search(r"\b(class|interface)\s+(\w+)([^()]*)$", plain)
    if m:
        named = {"name": m.group(2), "kind": m.group(1)}
        heritage = " ".join(m.group(3).split())
        heritage = heritage[heritage.index("extends"):] if "extends" in heritage else (
            heritage[heritage.index("implements"):] if "implements" in heritage else "")
        if m.group(1) == "class":
            named["signature"] = f"class {m.group(2)}" + (f" {heritage}" if heritage else "")
        return named
    m = re.match(r"^([^()=]*?)(\w+)\s*\((.*)\)\s*(?:throws\s[\w\s,.]+)?(?:default\s.*)?$", plain, re.S)
    if not m:
        return None
    words = m.group(1).split()
    mods = [w for w in words if w in (
        "public", "private", "protected", "static", "abstract", "final", "native", "synchronized", "default", "strictfp")]
    returned = " ".join(w for w in words if w not in mods)
    returned = re.sub(r"^<[^>]*>\s*", "", returned)
    if "new" in words or m.group(3).count("(") != m.group(3).count(")"):
        return None
    if not returned:
        return {"name": "", "kind": "constructor"}
    pairs = [p.replace("final ", "").rsplit(" ", 1) for p in _split_params(m.group(3))]
    return {
        "name": m.group(2), "kind": "method", "return_type": returned,
        "params": [{"name": p[-1], "type": _java_type(p[0]) if len(p) > 1 else "", "default": ""} for p in pairs],
        "visibility": next((w for w in reversed(mods) if w in ("public", "private", "protected")), ""),
        "is_static": "static" in mods, "is_abstract": "abstract" in mods,
    }


class _Scope:
    __slots__ = ("start", "body", "end", "name", "kind", "fact", "qual", "depth")

    def __init__(self, start, body, name, kind, fact, qual, depth):
        self.start, self.body, self.end = start, body, -1
        self.name, self.kind, self.fact, self.qual, self.depth = name, kind, fact, qual, depth


def brace_facts(
    source: str, head: Callable[[str], dict | None], separator: str, top: str,
    bodies: tuple[str, ...], statement: Callable[[str, str, str], list[dict]], signed: tuple[str, ...],
) -> list[dict]:
    """Scopes, declarations and calls of a brace language.

    ``head`` reads the text before a brace, ``statement`` a declaration that
    ends in a semicolon outside any ``bodies`` scope; ``signed`` kinds get the
    first line of their text as signature.
    """
    code = _LITERAL.sub(_blank, source)
    code = _DIRECTIVE.sub(_blank, code)
    starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def line_at(position: int) -> int:
        return bisect.bisect_right(starts, position)

    facts: list[tuple[int, dict]] = []
    scopes: list[_Scope] = []
    stack: list[_Scope] = []
    heads: list[tuple[int, int]] = []
    begin, parens = 0, 0

    def first_text(at: int, end: int) -> int:
        while True:
            label = _LABEL.match(code[at:end])
            if not label:
                break
            at += label.end()
        rest = code[at:end]
        return at + len(rest) - len(rest.lstrip())

    def named() -> _Scope | None:
        return next((s for s in reversed(stack) if s.name), None)

    for token in re.finditer(r"[{};()]", code):
        char, at = token.group(), token.start()
        if char in "()":
            parens = max(0, parens + (1 if char == "(" else -1))
            continue
        if char == ";" and parens:
            continue
        opening = first_text(begin, at)
        text = code[opening:at].strip()
        outer = named()
        in_body = any(s.kind in bodies for s in stack)
        if char == "{":
            found = head(text) if text and not _CONTROL.match(text) else None
            if found and in_body and found["kind"] in ("function", "constructor"):
                found = None
            scope = _Scope(opening, at, "", "block", None, outer.qual if outer else "", parens)
            if found:
                scope.kind = found["kind"]
                heads.append((opening, at))
                if found["name"]:
                    qual = f"{outer.qual}{separator}{found['name']}" if outer else found["name"]
                    scope.name, scope.qual = found["name"], qual
                    scope.fact = symbol(
                        found["name"], found["kind"], line_at(opening), 0, parent=outer.qual if outer else "",
                        **{k: v for k, v in found.items() if k not in ("name", "kind")},
                    )
                    if found["kind"] in signed:
                        scope.fact["signature"] = source[opening:at + 1].split("\n")[0].strip()[:CHARS_SIGNATURE]
                    facts.append((opening, scope.fact))
            stack.append(scope)
            scopes.append(scope)
            parens = 0
        elif char == "}":
            if stack:
                scope = stack.pop()
                scope.end, parens = at, scope.depth
                if scope.fact:
                    scope.fact["end_line"] = line_at(at)
        elif text and not in_body:
            declared = statement(text, source[opening:at], outer.qual if outer else "")
            for fact in declared:
                fact.update(line=line_at(opening), end_line=line_at(at))
                facts.append((opening, fact))
            if "=" not in text:
                heads.append((opening, at))
        begin = at + 1
    for scope in stack:
        scope.end = len(code)
        if scope.fact:
            scope.fact["end_line"] = line_at(len(source) - 1) if source else 1
    facts += _calls(source, code, scopes, heads, line_at, top, separator == "::")
    facts.sort(key=lambda f: f[0])
    return [f for _, f in facts]


def _word_before(code: str, at: int) -> int:
    """Where the text before ``at`` ends, white space left out."""
    while at and code[at - 1].isspace():
        at -= 1
    return at


def _chain_start(code: str, at: int, arrow: bool) -> int:
    """Start of the receiver chain that leads to the name at ``at``."""
    while True:
        link = _LINK[arrow].search(code, max(0, _word_before(code, at) - 2), at)
        if not link:
            return at
        at = link.start()
        while at and code[at - 1].isspace():
            at -= 1
        while at and code[at - 1] in ")]":
            close, level = code[at - 1], 0
            opener = "(" if close == ")" else "["
            while at:
                at -= 1
                level += (code[at] == close) - (code[at] == opener)
                if not level:
                    break
        while at and (code[at - 1].isalnum() or code[at - 1] in "_$"):
            at -= 1


def _calls(source, code, scopes, heads, line_at, top, arrow=False) -> list[tuple[int, dict]]:
    named = sorted((s for s in scopes if s.name), key=lambda s: s.body)
    heads = sorted(heads)
    head_starts = [h[0] for h in heads]
    out, active, upcoming = [], [], 0
    for call in _NAMED_CALL.finditer(code):
        at = call.start()
        if call.group() in _NO_CALL:
            continue
        while upcoming < len(named) and named[upcoming].body < at:
            active.append(named[upcoming])
            upcoming += 1
        while active and active[-1].end < at:
            active.pop()
        h = bisect.bisect_right(head_starts, at) - 1
        if h >= 0 and at < heads[h][1]:
            continue
        end = _word_before(code, at)
        before = code[max(0, end - 12):end]
        if before.endswith("@") or re.search(r"\b(?:new|class|def|object|trait)$", before):
            continue
        start = _chain_start(code, at, arrow)
        end = _word_before(code, start)
        lead = code[max(0, end - 12):end]
        if lead.endswith("@"):
            continue
        if re.search(r"\bnew$", lead):
            start = code.rindex("new", 0, start)
        out.append((at, edge(active[-1].qual if active else top, source[start:call.end()], line_at(start))))
    return out


def _c_statement(text: str, raw: str, parent: str) -> list[dict]:
    if not parent:
        return []
    kind, declarator = _c_declared(text.split("=")[0])
    if not declarator or kind in ("using", "typedef", "friend", "return"):
        return []
    return [symbol(declarator[:CHARS_VALUE], "variable", 0, 0, signature=f"{kind} {declarator}", parent=parent)]


def _java_statement(text: str, raw: str, parent: str) -> list[dict]:
    m = re.match(r"import\s+(?:static\s+)?([\w.*]+)$", " ".join(text.split()))
    if m:
        return [imported(m.group(1), 0)]
    if not parent:
        return []
    found = _java_head(text) if "(" in text.split("=")[0] else None
    if found and found["kind"] == "method":
        return [symbol(
            found["name"], "method", 0, 0, parent=parent, signature=raw.split("\n")[0].strip()[:CHARS_SIGNATURE],
            **{k: v for k, v in found.items() if k not in ("name", "kind")},
        )]
    if found:
        return []
    names = [re.search(r"(\w+)\s*(?:\[\])*\s*(?:=|$)", p) for p in _split_params(text)]
    return [symbol(n.group(1), "variable", 0, 0, parent=parent) for n in names if n]


def c_facts(source: str) -> list[dict]:
    includes = []
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|"[^"\n]+")', source, re.M):
        includes.append(imported(m.group(1), source.count("\n", 0, m.start(1)) + 1))
    return includes + brace_facts(source, _c_head, "::", "<file>", ("function",), _c_statement, ("function",))


def java_facts(source: str) -> list[dict]:
    return brace_facts(source, _java_head, ".", "<class>", ("method", "constructor"), _java_statement, ("method",))


# Scala has no statement ends: declarations are found by keyword and end at the
# first line end outside brackets that nothing continues.
_SCALA_DECLARATION = re.compile(r"\b(class|trait|object|def)\s+([A-Za-z_$][\w$]*)")
_SCALA_GOES_ON = re.compile(r"(?:[=,+\-*/&|.:({\[]|\b(?:extends|with|else|yield))\s*$")
_SCALA_NEXT = re.compile(r"\s*(?:[.{]|extends\b|with\b|else\b|yield\b)")


def scala_facts(source: str) -> list[dict]:
    code = _LITERAL.sub(_blank, source)
    starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def line_at(position: int) -> int:
        return bisect.bisect_right(starts, position)

    def span_end(at: int) -> int:
        level, line_start = 0, at
        for token in re.finditer(r"[(){}\[\]\n]", code[at:]):
            char, here = token.group(), at + token.start()
            if char == "\n":
                if level <= 0 and not _SCALA_GOES_ON.search(code[line_start:here]) and not _SCALA_NEXT.match(code, here):
                    return here
                line_start = here + 1
            elif char in "({[":
                level += 1
            else:
                level -= 1
                if level < 0:
                    return here
        return len(code)

    facts = [
        (m.start(), imported(" ".join(m.group(1).split()), line_at(m.start())))
        for m in re.finditer(r"^[ \t]*import\s+(.+?)\s*$", code, re.M)
    ]
    scopes: list[_Scope] = []
    heads: list[tuple[int, int]] = []
    stack: list[_Scope] = []
    for m in _SCALA_DECLARATION.finditer(code):
        opening = m.start()
        lead = re.search(r"(?:\b(?:case|abstract|final|sealed|implicit|override|private|protected|lazy)(?:\[\w+\])?\s+)+$", code[:opening][-120:])
        start = opening - len(lead.group()) if lead else opening
        while stack and stack[-1].end <= opening:
            stack.pop()
        outer = stack[-1] if stack else None
        qual = f"{outer.qual}.{m.group(2)}" if outer else m.group(2)
        end = span_end(m.end())
        kind = m.group(1) if m.group(1) != "def" else ("method" if outer else "function")
        fact = symbol(m.group(2), kind, line_at(start), line_at(max(start, end - 1)), parent=outer.qual if outer else "")
        if m.group(1) == "def":
            fact["signature"] = source[start:end].split("\n")[0].strip()[:CHARS_SIGNATURE]
        facts.append((start, fact))
        scope = _Scope(start, m.end(), m.group(2), kind, fact, qual, 0)
        scope.end = end
        stack.append(scope)
        scopes.append(scope)
        heads.append((opening, m.end() + 1))
    facts += _calls(source, code, scopes, heads, line_at, "<file>")
    facts.sort(key=lambda f: f[0])
    return [f for _, f in facts]


EXTRACTORS: dict[str, Callable[[str], list[dict]]] = {
    "Python": python_facts, "XML": xml_facts, "C": c_facts, "C++": c_facts, "Java": java_facts, "Scala": scala_facts,
}
