"""A small sandboxed template language, compiled to Python closures.

Text, ``{{ expression }}``, ``{% for x in expression %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}`` and
``{% generation %}`` ... ``{% endgeneration %}``, which marks what a model is to learn. Expressions
have strings, whole numbers, names, ``x.field``, ``== != ~ and or not``, brackets and the filters given to the
compiler. There are no calls, and fields are looked up in mappings only, so a template
reaches nothing but its context.

A template is parsed into a syntax tree, constant parts are folded, and each node becomes a
generator of (text, whether generated), so a conversation of any length is rendered piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

Filter = Callable[[str], str]
Render = Callable[[dict], Iterator[tuple[str, bool]]]
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEXEME = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~.|()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Apply:
    filter: str
    to: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass
class Output:
    value: Any


@dataclass
class Loop:
    name: str
    over: Any
    body: list


@dataclass
class Branches:
    cases: list  # of (condition, body)
    otherwise: list = field(default_factory=list)


@dataclass
class Generation:
    body: list


class _Expression:
    """Recursive descent over the lexemes of one expression."""

    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _LEXEME.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            kind = ("string", "number", "name", "sign")[m.lastindex - 1]
            self.items.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("name", "sign") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def whole(self) -> Any:
        value = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return value

    def _chain(self, op: str, sign: str, part: Callable[[], Any]) -> Any:
        args = [part()]
        while self.take(sign):
            args.append(part())
        return args[0] if len(args) == 1 else Op(op, tuple(args))

    def either(self) -> Any:
        return self._chain("or", "or", self.both)

    def both(self) -> Any:
        return self._chain("and", "and", self.negated)

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.joined()
        for sign in ("==", "!="):
            if self.take(sign):
                return Op(sign, (left, self.joined()))
        return left

    def joined(self) -> Any:
        return self._chain("~", "~", self.filtered)

    def filtered(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                value = Field(value, self._name())
            elif self.take("|"):
                value = Apply(self._name(), value)
            else:
                return value

    def _name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return text

    def atom(self) -> Any:
        kind, text = self.peek()
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if kind == "name" and text not in ("and", "or", "not"):
            return Const(text == "true") if text in ("true", "false") else Name(text)
        if text == "(":
            value = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return value
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Output(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Output(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, node, body = stack[-1]
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not found:
                raise TemplateError("for needs 'name in expression'")
            node = Loop(found[1], _Expression(found[2]).whole(), [])
            body.append(node)
            stack.append(("for", node, node.body))
        elif word == "if":
            inner: list = []
            node = Branches([(_Expression(rest).whole(), inner)])
            body.append(node)
            stack.append(("if", node, inner))
        elif word == "elif" and kind == "if":
            inner = []
            node.cases.append((_Expression(rest).whole(), inner))
            stack[-1] = ("if", node, inner)
        elif word == "else" and kind == "if":
            stack[-1] = ("else", node, node.otherwise)
        elif word == "generation":
            node = Generation([])
            body.append(node)
            stack.append(("generation", node, node.body))
        elif word.startswith("end") and word[3:] == kind.replace("else", "if") and kind:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {word!r}")
    if at < len(source):
        stack[-1][2].append(Output(Const(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is open")
    return root


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class Compiler:
    def __init__(self, filters: Mapping[str, Filter]) -> None:
        self.filters = dict(filters)

    # Folding.
    def fold(self, e: Any) -> Any:
        """An expression with its constant parts computed."""
        if isinstance(e, Field):
            return Field(self.fold(e.of), e.name)
        if isinstance(e, Apply):
            if e.filter not in self.filters:
                raise TemplateError(f"no filter {e.filter!r}")
            e = Apply(e.filter, self.fold(e.to))
            return Const(self.value(e)({})) if isinstance(e.to, Const) else e
        if isinstance(e, Op):
            e = Op(e.op, tuple(map(self.fold, e.args)))
            if e.op in ("and", "or"):
                known = [bool(a.value) for a in e.args if isinstance(a, Const)]
                if (e.op == "or") in known:
                    return Const(e.op == "or")
            if all(isinstance(a, Const) for a in e.args):
                return Const(self.value(e)({}))
        return e

    def fold_all(self, nodes: list) -> list:
        """A tree with folded expressions, dead branches gone and neighbouring texts joined."""
        out: list = []

        def add(node: Any) -> None:
            if isinstance(node, Output) and isinstance(node.value, Const):
                text = _text(node.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Output(Const(text)))
            else:
                out.append(node)

        for node in nodes:
            if isinstance(node, Output):
                add(Output(self.fold(node.value)))
            elif isinstance(node, Loop):
                add(Loop(node.name, self.fold(node.over), self.fold_all(node.body)))
            elif isinstance(node, Generation):
                add(Generation(self.fold_all(node.body)))
            else:
                cases: list = []
                otherwise = node.otherwise
                for condition, body in node.cases:
                    condition = self.fold(condition)
                    if isinstance(condition, Const) and condition.value:
                        otherwise = body
                        break
                    if not isinstance(condition, Const):
                        cases.append((condition, self.fold_all(body)))
                rest = self.fold_all(otherwise)
                for one in [Branches(cases, rest)] if cases else rest:
                    add(one)
        return out

    # Closures.
    def value(self, e: Any) -> Callable[[dict], Any]:
        if isinstance(e, Const):
            return lambda context, v=e.value: v
        if isinstance(e, Name):
            return lambda context, n=e.name: context.get(n)
        if isinstance(e, Field):
            of, name = self.value(e.of), e.name
            return lambda context: v.get(name) if isinstance(v := of(context), Mapping) else None
        if isinstance(e, Apply):
            to, apply = self.value(e.to), self.filters[e.filter]
            return lambda context: apply(_text(to(context)))
        args = [self.value(a) for a in e.args]
        if e.op == "not":
            return lambda context: not args[0](context)
        if e.op == "and":
            return lambda context: all(a(context) for a in args)
        if e.op == "or":
            return lambda context: any(a(context) for a in args)
        if e.op == "~":
            return lambda context: "".join(_text(a(context)) for a in args)
        same = e.op == "=="
        return lambda context: (args[0](context) == args[1](context)) is same

    def body(self, nodes: list, generated: bool = False) -> Render:
        parts = [self.node(n, generated) for n in nodes]

        def render(context: dict) -> Iterator[tuple[str, bool]]:
            for part in parts:
                yield from part(context)

        return render

    def node(self, node: Any, generated: bool) -> Render:
        if isinstance(node, Output):
            value = self.value(node.value)

            def output(context: dict) -> Iterator[tuple[str, bool]]:
                yield _text(value(context)), generated

            return output
        if isinstance(node, Generation):
            return self.body(node.body, True)
        if isinstance(node, Loop):
            over, name, inner = self.value(node.over), node.name, self.body(node.body, generated)

            def loop(context: dict) -> Iterator[tuple[str, bool]]:
                for item in over(context) or ():
                    yield from inner(context | {name: item})

            return loop
        cases = [(self.value(c), self.body(b, generated)) for c, b in node.cases]
        otherwise = self.body(node.otherwise, generated)

        def branches(context: dict) -> Iterator[tuple[str, bool]]:
            for condition, inner in cases:
                if condition(context):
                    return inner(context)
            return otherwise(context)

        return branches


def compile_template(source: str, filters: Mapping[str, Filter]) -> Render:
    compiler = Compiler(filters)
    return compiler.body(compiler.fold_all(parse(source)))
