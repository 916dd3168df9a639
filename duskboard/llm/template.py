"""A sandboxed template language, compiled to Python closures.

    text, {{ expression }}, {% for x in expression %} ... {% endfor %},
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %},
    {% generation %} ... {% endgeneration %}

An expression has strings, whole numbers, true, false, none, names, fields (m.role), filters (m.text | escape),
==, !=, not, and, or, and + for joining texts. A name or field that is not there is none, and none prints as
nothing. Fields are looked up in mappings only and there are no calls, so a template reaches nothing but what it
is given. In a loop, loop.first, loop.index and loop.index0 are set. A minus sign inside a tag ({%- or -%}) strips
the white space beside it.

Constants are folded when the template is compiled: expressions of constants, conditions that are known, and
neighbouring texts. What stands in a generation block is recorded as a span of the output, in characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.|()+]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t"}
WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


class Output:
    """What was written so far and the spans of it that a model generates."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


# Syntax tree: tuples whose first field is the kind. Expressions: const, name, field, filter, equal, not, and, or,
# join. Statements: text, print, for, if, generation.


class _Expression:
    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read: {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def _next(self, *wanted: str) -> str | None:
        kind, value = self.items[self.at] if self.at < len(self.items) else (None, None)
        if kind != "text" and value in wanted:
            self.at += 1
            return value
        return None

    def parse(self) -> tuple:
        tree = self._or()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected: {self.items[self.at][1]!r}")
        return tree

    def _or(self) -> tuple:
        left = self._and()
        while self._next("or"):
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self._next("and"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        return ("not", self._not()) if self._next("not") else self._equal()

    def _equal(self) -> tuple:
        left = self._join()
        while sign := self._next("==", "!="):
            left = ("equal", left, self._join())
            left = ("not", left) if sign == "!=" else left
        return left

    def _join(self) -> tuple:
        left = self._filtered()
        while self._next("+"):
            left = ("join", left, self._filtered())
        return left

    def _filtered(self) -> tuple:
        left = self._atom()
        while sign := self._next(".", "|"):
            left = ("field" if sign == "." else "filter", left, self._name())
        return left

    def _name(self) -> str:
        kind, value = self.items[self.at] if self.at < len(self.items) else (None, None)
        if kind != "name":
            raise TemplateError(f"a name is wanted, not {value!r}")
        self.at += 1
        return value

    def _atom(self) -> tuple:
        if self._next("("):
            inner = self._or()
            if not self._next(")"):
                raise TemplateError("a bracket is not closed")
            return inner
        if self.at >= len(self.items):
            raise TemplateError("an expression ends too early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            return ("const", WORDS[value]) if value in WORDS else ("name", value)
        raise TemplateError(f"unexpected: {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of statements."""
    pieces = TAG.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(pieces):
            piece, tag = pieces[at], at % 2
            at += 1
            if not tag:
                if piece:
                    body.append(("text", piece))
                continue
            inside = piece[2:-2].removeprefix("-").removesuffix("-").strip()
            if piece.startswith("{{"):
                body.append(("print", _Expression(inside).parse()))
                continue
            word, _, rest = inside.partition(" ")
            if word in ends:
                return body, inside
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read: {inside!r}")
                body.append(("for", m[1], _Expression(m[2]).parse(), block(("endfor",))[0]))
            elif word == "if":
                body.append(branch(rest))
            elif word == "generation":
                body.append(("generation", block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag: {inside!r}")
        if ends:
            raise TemplateError(f"missing: {ends[-1]}")
        return body, ""

    def branch(condition: str) -> tuple:
        tree = _Expression(condition).parse()
        then, end = block(("elif", "else", "endif"))
        word, _, rest = end.partition(" ")
        other = [branch(rest)] if word == "elif" else block(("endif",))[0] if word == "else" else []
        return ("if", tree, then, other)

    return block(())[0]


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """The expression with its constant parts worked out."""
    kind, *rest = tree
    if kind == "filter" and rest[1] not in filters:
        raise TemplateError(f"unknown filter: {rest[1]}")
    rest = [fold(x, filters) if isinstance(x, tuple) else x for x in rest]
    trees = [x for x in rest if isinstance(x, tuple)]
    if trees and all(x[0] == "const" for x in trees):
        return ("const", _closure((kind, *rest), filters)({}))
    return (kind, *rest)


def fold_body(body: list[tuple], filters: dict[str, Callable[[str], str]]) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for kind, *rest in body:
        if kind == "print":
            tree = fold(rest[0], filters)
            add(("text", _shown(tree[1])) if tree[0] == "const" else ("print", tree))
        elif kind == "if":
            tree, then, other = fold(rest[0], filters), fold_body(rest[1], filters), fold_body(rest[2], filters)
            for node in (then if tree[1] else other) if tree[0] == "const" else [("if", tree, then, other)]:
                add(node)
        elif kind == "for":
            out.append(("for", rest[0], fold(rest[1], filters), fold_body(rest[2], filters)))
        elif kind == "generation":
            out.append(("generation", fold_body(rest[0], filters)))
        else:
            add((kind, *rest))
    return out


def _closure(tree: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], object]:
    kind, *rest = tree
    if kind == "const":
        return lambda env: rest[0]
    if kind == "name":
        return lambda env: env.get(rest[0])
    first = _closure(rest[0], filters)
    if kind == "field":
        return lambda env: value.get(rest[1]) if isinstance(value := first(env), dict) else None
    if kind == "filter":
        return lambda env, change=filters[rest[1]]: change(_shown(first(env)))
    if kind == "not":
        return lambda env: not first(env)
    second = _closure(rest[1], filters)
    if kind == "equal":
        return lambda env: first(env) == second(env)
    if kind == "and":
        return lambda env: first(env) and second(env)
    if kind == "or":
        return lambda env: first(env) or second(env)
    return lambda env: _shown(first(env)) + _shown(second(env))


def _statement(node: tuple, filters: dict[str, Callable[[str], str]]) -> Callable[[dict, Output], None]:
    kind, *rest = node
    if kind == "text":
        return lambda env, out: out.write(rest[0])
    if kind == "print":
        value = _closure(rest[0], filters)
        return lambda env, out: out.write(_shown(value(env)))
    if kind == "if":
        value, then, other = _closure(rest[0], filters), _body(rest[1], filters), _body(rest[2], filters)
        return lambda env, out: (then if value(env) else other)(env, out)
    if kind == "generation":
        inner = _body(rest[0], filters)

        def generation(env: dict, out: Output) -> None:
            start = out.size
            inner(env, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return generation
    name, items, inner = rest[0], _closure(rest[1], filters), _body(rest[2], filters)

    def loop(env: dict, out: Output) -> None:
        given = items(env)
        if isinstance(given, str | dict) or not isinstance(given, Iterable):
            given = ()
        for i, item in enumerate(given):
            inner({**env, name: item, "loop": {"first": i == 0, "index": i + 1, "index0": i}}, out)

    return loop


def _body(body: list[tuple], filters: dict[str, Callable[[str], str]]) -> Callable[[dict, Output], None]:
    steps = [_statement(node, filters) for node in body]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to the text and its generated spans."""
    run = _body(fold_body(parse(source), filters), filters)

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(values, out)
        return "".join(out.parts), out.spans

    return render
