"""A small sandboxed template language, compiled to Python closures.

Syntax: ``{{ expression }}``, ``{% for x in list %} ... {% endfor %}``, ``{% if %} ... {% elif %} ... {% else %} ... {% endif %}``,
``{% generation %} ... {% endgeneration %}`` and ``{# remark #}``. Expressions have strings, integers, true, false, none, names,
``a.b`` and ``a['b']`` (look-up in mappings only), ``loop.index0 | loop.index | loop.first``, ``+ == != and or not``, brackets
and filters (``| name``). There are no calls, attributes of objects, imports or writes: a template reaches only the values and
filters it is given. Text is parsed into a syntax tree, constant parts are folded, and each node becomes a closure that
yields (text, inside generation) pieces, so long conversations stream.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not of the language, or asks for a value that isn't there."""


# ---- syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Text:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple = field(default=())  # (condition, body) pairs; the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parser --------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        kind = ("string", "number", "name", "mark")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression, weakest binding first."""

    def __init__(self, source: str):
        self.left, self.source = _tokens(source), source

    def parse(self) -> object:
        out = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r} in {self.source!r}")
        return out

    def peek(self, *values: str) -> bool:
        return bool(self.left) and self.left[0][0] != "string" and self.left[0][1] in values

    def take(self, *values: str) -> str:
        if not self.left or (values and not self.peek(*values)):
            raise TemplateError(f"expected {' or '.join(values) or 'a value'} in {self.source!r}")
        return self.left.pop(0)[1]

    def either(self):
        out = self.both()
        while self.peek("or"):
            out = Binary(self.take(), out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.peek("and"):
            out = Binary(self.take(), out, self.negated())
        return out

    def negated(self):
        if self.peek("not"):
            self.take()
            return Not(self.negated())
        return self.compared()

    def compared(self):
        out = self.added()
        if self.peek("==", "!="):
            out = Binary(self.take(), out, self.added())
        return out

    def added(self):
        out = self.filtered()
        while self.peek("+"):
            out = Binary(self.take(), out, self.filtered())
        return out

    def filtered(self):
        out = self.looked_up()
        while self.peek("|"):
            self.take()
            out = Filter(self.take(), out)
        return out

    def looked_up(self):
        out = self.value()
        while self.peek(".", "["):
            if self.take() == ".":
                out = Item(out, Const(self.take()))
            else:
                out = Item(out, self.either())
                self.take("]")
        return out

    def value(self):
        if not self.left:
            raise TemplateError(f"a value is missing in {self.source!r}")
        kind, v = self.left.pop(0)
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(v))
        if v == "(":
            out = self.either()
            self.take(")")
            return out
        if kind == "name" and v not in ("and", "or", "not"):
            return Const({"true": True, "false": False, "none": None}[v]) if v in ("true", "false", "none") else Name(v)
        raise TemplateError(f"unexpected {v!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("value", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    parts = [p for p in parts if p != ("text", "")]
    body, left, end = _body(parts, ())
    if end:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _body(parts: list, ends: tuple[str, ...]) -> tuple[tuple, list, str]:
    """Nodes up to one of the ending tags; the parts after it; the tag."""
    nodes: list[object] = []
    while parts:
        (kind, v), parts = parts[0], parts[1:]
        word = v.split(None, 1)[0] if kind == "tag" and v else ""
        if kind == "text":
            nodes.append(Text(Const(v)))
        elif kind == "value":
            nodes.append(Text(_Expression(v).parse()))
        elif word in ends:
            return tuple(nodes), parts, v
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", v, re.S)
            if not m:
                raise TemplateError(f"not a loop: {v!r}")
            inner, parts, _ = _body(parts, ("endfor",))
            nodes.append(For(m[1], _Expression(m[2]).parse(), inner))
        elif word == "generation":
            inner, parts, _ = _body(parts, ("endgeneration",))
            nodes.append(Generation(inner))
        elif word == "if":
            branches, condition = [], _Expression(v[2:]).parse()
            while True:
                inner, parts, end = _body(parts, ("elif", "else", "endif"))
                branches.append((condition, inner))
                if end == "endif":
                    break
                condition = Const(True) if end == "else" else _Expression(end[4:]).parse()
            nodes.append(If(tuple(branches)))
        else:
            raise TemplateError(f"unknown tag {v!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), [], ""


# ---- constant folding ----------------------------------------------------------------------------


def fold(node: object, filters: Mapping[str, Callable]) -> object:
    """The same tree with constant expressions worked out, dead branches gone and constant texts joined."""
    if isinstance(node, tuple):
        flat: list[object] = []
        for n in node:
            n = fold(n, filters)
            flat += n if isinstance(n, tuple) else [n]
        out: list[object] = []
        for n in flat:
            if out and all(isinstance(x, Text) and isinstance(x.of, Const) for x in (n, out[-1])):
                out[-1] = Text(Const(as_text(out[-1].of.value) + as_text(n.of.value)))
            elif n != Text(Const("")):
                out.append(n)
        return tuple(out)
    if isinstance(node, Text):
        return Text(fold(node.of, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, fold(body, filters)))
            if isinstance(condition, Const):
                break
        if not branches:
            return ()
        return branches[0][1] if isinstance(branches[0][0], Const) else If(tuple(branches))
    if isinstance(node, (Item, Not, Binary, Filter)):
        parts = {k: fold(v, filters) if not isinstance(v, str) else v for k, v in vars(node).items()}
        node = type(node)(**parts)
        if all(isinstance(v, (Const, str)) for v in parts.values()):
            return Const(_value(node, filters)({}))
    return node


# ---- closures ------------------------------------------------------------------------------------


def as_text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _value(node: object, filters: Mapping[str, Callable]) -> Callable[[Mapping], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):

        def name(scope, n=node.name):
            if n not in scope:
                raise TemplateError(f"no value named {n!r}")
            return scope[n]

        return name
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope):
            held = of(scope)
            if not isinstance(held, Mapping):
                raise TemplateError("only mappings have items")
            return held.get(key(scope))

        return item
    if isinstance(node, Not):
        inner = _value(node.of, filters)
        return lambda scope: not inner(scope)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter named {node.name!r}")
        inner, f = _value(node.of, filters), filters[node.name]
        return lambda scope: f(inner(scope))
    a, b = _value(node.left, filters), _value(node.right, filters)
    return {
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: _plus(a(scope), b(scope)),
    }[node.op]


def _plus(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else as_text(a) + as_text(b)


def _render(nodes: tuple, filters: Mapping[str, Callable], inside: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(n, filters, inside) for n in nodes]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: object, filters: Mapping[str, Callable], inside: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        value = _value(node.of, filters)
        return lambda scope: iter(((as_text(value(scope)), inside),))
    if isinstance(node, Generation):
        return _render(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_value(c, filters), _render(body, filters, inside)) for c, body in node.branches]

        def choose(scope: dict) -> Iterator[Piece]:
            for condition, body in branches:
                if condition(scope):
                    yield from body(scope)
                    return

        return choose
    over, body, name = _value(node.over, filters), _render(node.body, filters, inside), node.name

    def loop(scope: dict) -> Iterator[Piece]:
        for i, item in enumerate(over(scope)):
            yield from body(scope | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}})

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping[str, object]], Iterator[Piece]]:
    """A function from named values (lists may be iterators) to (text, inside generation) pieces."""
    filters = filters or {}
    render = _render(fold(parse(source), filters), filters)

    def call(values: Mapping[str, object]) -> Iterable[Piece]:
        return render(dict(values))

    return call
