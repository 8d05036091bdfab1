"""A small, sandboxed template language: source text -> syntax tree -> Python closures.

    {{ expression }}                      output
    {% for name in expression %} .. {% endfor %}
    {% if expression %} .. {% elif expression %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}   marks what the model is to generate

Expressions: strings, integers, true, false, none, names, name.field, loop.index0,
loop.first, + (concatenation or sum), ==, !=, and, or, not, parentheses and the
filters | trim, upper, lower, escape. Nothing else is reachable: no calls, no
attributes of Python objects, no indexing, so a template cannot run code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Node = tuple
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().+|]))")
_ESCAPES = {"n": "\n", "t": "\t"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox does not have."""


def escape(text: str) -> str:
    """text with every control opener "<|" broken up, reversibly."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
        text, number, name, op = m.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("const", int(number)))
        elif name is not None:
            out.append(("const", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name))
        else:
            out.append(("op", op))
        at = m.end()
    return out + [("end", None)]


class _Expression:
    """Recursive descent: or < and < not < comparison < + < filter < atom."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def take(self, kind: str, value: Any = None) -> Any:
        k, v = self.tokens[self.at]
        if k != kind or value is not None and v != value:
            return None
        self.at += 1
        return (v,)

    def parse(self) -> Node:
        node = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("name", "or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("name", "and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("name", "not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        for op in ("==", "!="):
            if self.take("op", op):
                return (op, node, self.added())
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("op", "+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("op", "|"):
            name = self.take("name")
            if not name or name[0] not in FILTERS:
                raise TemplateError(f"no such filter: {name and name[0]}")
            node = ("filter", name[0], node)
        return node

    def atom(self) -> Node:
        if self.take("op", "("):
            node = self.either()
            if not self.take("op", ")"):
                raise TemplateError("missing )")
            return node
        if const := self.take("const"):
            return ("const", const[0])
        if not (name := self.take("name")):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        path = [name[0]]
        while self.take("op", "."):
            if not (field := self.take("name")) or field[0].startswith("_"):
                raise TemplateError("bad field name")
            path.append(field[0])
        return ("get", *path)


def parse(source: str) -> Node:
    """The syntax tree of a template: ("block", node, ...)."""
    stack: list[tuple[str, list, list]] = [("block", [], [])]
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, body, more = stack[-1]
        if word == "for":
            if not (f := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                raise TemplateError(f"bad for: {rest}")
            stack.append(("for", [], [f[1], _Expression(f[2]).parse()]))
        elif word == "if":
            stack.append(("if", [], [_Expression(rest).parse()]))
        elif word in ("elif", "else") and kind == "if":
            more.append(("block", *body))
            more.append(("const", True) if word == "else" else _Expression(rest).parse())
            body.clear()
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word.startswith("end") and word[3:] == kind:
            stack.pop()
            inner = ("block", *body)
            stack[-1][1].append(("if", *more, inner) if kind == "if" else ("for", *more, inner) if kind == "for" else ("generation", inner))
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[0][1].append(("text", source[at:]))
    return ("block", *stack[0][1])


def fold(node: Node) -> Node:
    """The tree with constant expressions evaluated, constant branches chosen and texts joined."""
    kind = node[0]
    if kind in ("const", "get", "text"):
        return node
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind in ("+", "==", "!=", "and", "or", "not"):
        inner = [fold(x) for x in node[1:]]
        if all(x[0] == "const" for x in inner):
            return ("const", _expression((kind, *inner))({}))
        return (kind, *inner)
    if kind == "out":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("out", inner)
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        branches: list[Node] = []
        for test, body in zip(node[1::2], node[2::2]):
            test, body = fold(test), fold(body)
            if test[0] == "const" and not test[1]:
                continue
            branches += [test, body]
            if test[0] == "const":
                break
        if not branches:
            return ("block",)
        return branches[1] if branches[0][0] == "const" else ("if", *branches)
    flat: list[Node] = []
    for x in map(fold, node[1:]):
        for y in x[1:] if x[0] == "block" else [x]:
            if y[0] == "text" and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + y[1])
            elif y != ("text", ""):
                flat.append(y)
    return ("block", *flat)


def _text(value: Any) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _expression(node: Node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "get":
        first, *rest = node[1:]

        def get(env: dict) -> Any:
            value = env.get(first)
            for field in rest:
                value = value.get(field) if isinstance(value, dict) else None
            return value

        return get
    if kind == "filter":
        f, inner = FILTERS[node[1]], _expression(node[2])
        return lambda env: f(_text(inner(env)))
    if kind == "not":
        inner = _expression(node[1])
        return lambda env: not inner(env)
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)

    def add(env: dict) -> Any:
        x, y = a(env), b(env)
        return x + y if isinstance(x, int) and isinstance(y, int) else _text(x) + _text(y)

    return add


#: A closure appends (text, generated) pieces to a list.
Render = Callable[[dict, list, bool], None]


def _closure(node: Node) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda env, out, gen, t=node[1]: out.append((t, gen))
    if kind == "out":
        value = _expression(node[1])
        return lambda env, out, gen: out.append((_text(value(env)), gen))
    if kind == "generation":
        inner = _closure(node[1])
        return lambda env, out, gen: inner(env, out, True)
    if kind == "if":
        branches = [(_expression(t), _closure(b)) for t, b in zip(node[1::2], node[2::2])]

        def choose(env: dict, out: list, gen: bool) -> None:
            for test, body in branches:
                if test(env):
                    return body(env, out, gen)

        return choose
    if kind == "for":
        name, items, body = node[1], _expression(node[2]), _closure(node[3])

        def loop(env: dict, out: list, gen: bool) -> None:
            for i, item in enumerate(items(env) or ()):
                body(env | {name: item, "loop": {"index0": i, "first": i == 0}}, out, gen)

        return loop
    parts = [_closure(x) for x in node[1:]]

    def block(env: dict, out: list, gen: bool) -> None:
        for p in parts:
            p(env, out, gen)

    return block


def compile_template(source: str) -> Callable[[dict], list[tuple[str, bool]]]:
    """A function from variables to pieces of text, each with whether it is generated."""
    run = _closure(fold(parse(source)))

    def render(env: dict) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        run(env, out, False)
        return out

    return render
