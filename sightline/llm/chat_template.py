"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                                  output
    {% for m in messages %} ... {% endfor %}          loop
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}          text that a model learns to produce

An expression has text literals, integers, names, fields (``m.text``), ``+``, ``==``, ``!=``, ``and``, ``or``,
``not``, brackets and filters (``m.text | escape``).  There are no calls, no attributes of Python objects and
no other statements, so a template cannot reach anything but the values it is given.

A template is parsed to a syntax tree, constant parts are folded, and each node becomes one closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not well formed, or names something it was not given."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    """An operator or filter on its arguments."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Loop:
    variable: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Branch:
    arms: tuple  # (condition, body) pairs; the condition of "else" is Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass
class Rendered:
    """Output so far: its parts, its length in code points, and the spans of generated text."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[|+.()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}
_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    LEVELS = (("or",), ("and",), ("==", "!="), ("+",))

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S)))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name and name not in ("and", "or", "not") else ("sign", name or sign))
            at = m.end()

    def parse(self) -> object:
        node = self._binary(0)
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r} in {self.source!r}")
        return node

    def _take(self, *signs: str) -> str | None:
        if self.tokens and self.tokens[0][0] == "sign" and self.tokens[0][1] in signs:
            return self.tokens.pop(0)[1]
        return None

    def _name(self) -> str:
        if not self.tokens or self.tokens[0][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        return self.tokens.pop(0)[1]

    def _binary(self, level: int) -> object:
        if level == len(self.LEVELS):
            return self._filtered()
        node = self._binary(level + 1)
        while sign := self._take(*self.LEVELS[level]):
            node = Op(sign, (node, self._binary(level + 1)))
        return node

    def _filtered(self) -> object:
        if self._take("not"):
            return Op("not", (self._filtered(),))
        node = self._primary()
        while self._take("|"):
            node = Op("|" + self._name(), (node,))
        return node

    def _primary(self) -> object:
        if self._take("("):
            node = self._binary(0)
            if not self._take(")"):
                raise TemplateError(f"a bracket is open in {self.source!r}")
            return node
        if self.tokens and self.tokens[0][0] == "const":
            return Const(self.tokens.pop(0)[1])
        path = [self._name()]
        while self._take("."):
            path.append(self._name())
        return Name(tuple(path))


def parse(template: str) -> tuple:
    """The syntax tree: a tuple of statements."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            pieces.append(("text", template[at : m.start()]))
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    body, closing = _block(pieces, ())
    if closing:
        raise TemplateError(f"{closing!r} closes nothing")
    return body


def _block(pieces: list, ends: tuple[str, ...]) -> tuple[tuple, str]:
    """Statements up to a tag whose first word is in ``ends``; returns them and that tag."""
    body: list = []
    while pieces:
        kind, source = pieces.pop(0)
        word = source.split(None, 1)[0] if kind == "tag" and source else ""
        if kind == "text":
            body.append(Output(Const(source)))
        elif kind == "out":
            body.append(Output(_Expression(source).parse()))
        elif word in ends or word in ("elif", "else", "endif", "endfor", "endgeneration"):
            if word not in ends:
                raise TemplateError(f"{source!r} closes nothing")
            return tuple(body), source
        elif word == "generation":
            inner, _ = _block(pieces, ("endgeneration",))
            body.append(Generation(inner))
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", source, re.S)
            if not m:
                raise TemplateError(f"cannot read {source!r}")
            inner, _ = _block(pieces, ("endfor",))
            body.append(Loop(m[1], _Expression(m[2]).parse(), inner))
        elif word == "if":
            arms, tag = [], source
            while tag.split(None, 1)[0] in ("if", "elif"):
                condition = _Expression(tag.split(None, 1)[1] if " " in tag else "").parse()
                inner, tag = _block(pieces, ("elif", "else", "endif"))
                arms.append((condition, inner))
            if tag == "else":
                inner, tag = _block(pieces, ("endif",))
                arms.append((Const(True), inner))
            body.append(Branch(tuple(arms)))
        else:
            raise TemplateError(f"unknown tag {source!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(body), ""


def fold(node: object, filters: dict[str, Callable], constants: dict[str, object]) -> object:
    """The same tree with constant names, operators and filters replaced by their values and text joined."""
    def again(n: object) -> object:
        return fold(n, filters, constants)

    if isinstance(node, tuple):
        flat: list = []
        for n in map(again, node):
            if isinstance(n, Branch) and not n.arms:
                continue
            flat += n.arms[0][1] if isinstance(n, Branch) and n.arms[0][0] == Const(True) else [n]
        out: list = []
        for n in flat:
            if not (isinstance(n, Output) and isinstance(n.value, Const)):
                out.append(n)
                continue
            text = _text(n.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                out[-1] = Output(Const(out[-1].value.value + text))
            elif text:
                out.append(Output(Const(text)))
        return tuple(out)
    if isinstance(node, Name) and len(node.path) == 1 and node.path[0] in constants:
        return Const(constants[node.path[0]])
    if isinstance(node, Op):
        args = tuple(map(again, node.args))
        if node.kind[0] == "|" and node.kind[1:] not in filters:
            raise TemplateError(f"unknown filter {node.kind[1:]!r}")
        if all(isinstance(a, Const) for a in args):
            return Const((filters[node.kind[1:]] if node.kind[0] == "|" else _OPS[node.kind])(*(a.value for a in args)))
        return Op(node.kind, args)
    if isinstance(node, Output):
        return Output(again(node.value))
    if isinstance(node, Loop):
        inner = {k: v for k, v in constants.items() if k != node.variable}
        return Loop(node.variable, again(node.items), fold(node.body, filters, inner))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    if isinstance(node, Branch):
        arms = []
        for condition, body in node.arms:
            condition = again(condition)
            if isinstance(condition, Const):
                if not condition.value:
                    continue
                arms.append((Const(True), again(body)))
                break
            arms.append((condition, again(body)))
        return Branch(tuple(arms))
    return node


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _compile_value(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        head, *rest = node.path

        def lookup(scope: dict) -> object:
            try:
                value = scope[head]
                for key in rest:
                    value = value[key]
            except (KeyError, TypeError, IndexError):
                raise TemplateError(f"unknown name {'.'.join(node.path)!r}") from None
            return value

        return lookup
    args = [_compile_value(a, filters) for a in node.args]
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    run = filters[node.kind[1:]] if node.kind[0] == "|" else _OPS[node.kind]
    if len(args) == 1:
        return lambda scope: run(args[0](scope))
    return lambda scope: run(args[0](scope), args[1](scope))


def _compile_body(body: tuple, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    steps = [_compile_statement(n, filters) for n in body]

    def run(scope: dict, out: Rendered) -> None:
        for step in steps:
            step(scope, out)

    return run


def _compile_statement(node: object, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda scope, out: out.write(text)
        value = _compile_value(node.value, filters)
        return lambda scope, out: out.write(_text(value(scope)))
    if isinstance(node, Loop):
        items, body = _compile_value(node.items, filters), _compile_body(node.body, filters)

        def loop(scope: dict, out: Rendered) -> None:
            inner = dict(scope)
            for item in items(scope):
                inner[node.variable] = item
                body(inner, out)

        return loop
    if isinstance(node, Branch):
        arms = [(_compile_value(c, filters), _compile_body(b, filters)) for c, b in node.arms]

        def branch(scope: dict, out: Rendered) -> None:
            for condition, body in arms:
                if condition(scope):
                    return body(scope, out)

        return branch
    body = _compile_body(node.body, filters)

    def generation(scope: dict, out: Rendered) -> None:
        start = out.length
        body(scope, out)
        out.spans.append((start, out.length))

    return generation


def compile_template(
    template: str, filters: dict[str, Callable[[str], str]] | None = None, constants: dict[str, object] | None = None,
) -> Callable[[dict], Rendered]:
    """A function from the values a template names to its rendered text and generation spans."""
    filters = filters or {}
    body = _compile_body(fold(parse(template), filters, constants or {}), filters)

    def render(values: dict) -> Rendered:
        out = Rendered()
        body(values, out)
        return out

    return render
