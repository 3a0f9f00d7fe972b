"""A small sandboxed template language for chat formats, compiled to Python closures.

    {{ expression }}                        output; null and missing are empty
    {% for x in list %} ... {% endfor %}    with loop.index, index0, first, last
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}  what the model is to learn
    {# comment #}                           "-" inside a tag trims the text beside it

Expressions know strings, whole numbers, lists, true, false, none, names, ``a.b``,
``a[b]``, ``+``, ``~`` (joined as text), comparisons, ``in``, ``not``, ``and``,
``or``, ``a if b else c``, and filters. There are no calls, imports or
attributes of Python objects: a dot or bracket only looks into dicts and lists,
and names that begin with an underscore are refused.

A template is parsed into a syntax tree; constant expressions, conditions and
neighbouring texts are folded; each node left becomes a closure. Statements are
generators of texts and of the two generation marks, and a loop takes its list
as a stream with one item of look-ahead, so a conversation of any length is
rendered piece by piece.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any


class TemplateError(ValueError):
    """The template breaks a rule of the language."""


BEGIN, END = object(), object()
DEEPEST = 60

# ---- the syntax tree -------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A pure function of other expressions; ``how`` names an operator or a filter."""

    how: str
    parts: tuple


@dataclass(frozen=True)
class Choice:
    """``kind`` is and, or, if: what is not chosen is not evaluated."""

    kind: str
    parts: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, block)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    block: tuple


@dataclass(frozen=True)
class Generation:
    block: tuple


# ---- values ----------------------------------------------------------------


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written; use tojson")


def look_up(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    if of is None:
        return None
    raise TemplateError("a dot or bracket only looks into dicts and lists")


def plus(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str):
        return a + b
    raise TemplateError("+ takes two numbers or two texts")


@lru_cache(maxsize=64)
def controls(strings: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?=" + "|".join(map(re.escape, ("\\", *strings))) + ")")


def escape(text: Any, *strings: str) -> str:
    """A backslash before each place where a control string or a backslash begins."""
    return controls(strings).sub("\\\\", as_text(text))


UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text) if "\\" in text else text


def length(value: Any) -> int:
    if isinstance(value, (str, list, tuple, dict)):
        return len(value)
    raise TemplateError("length takes a text or a list; a stream has none")


PURE: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "not": operator.not_,
    "+": plus,
    "~": lambda a, b: as_text(a) + as_text(b),
    "list": lambda *parts: list(parts),
    "item": look_up,
}
FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": lambda t: as_text(t).strip(),
    "upper": lambda t: as_text(t).upper(),
    "lower": lambda t: as_text(t).lower(),
    "replace": lambda t, a, b: as_text(t).replace(a, b),
    "default": lambda t, other: other if t is None else t,
    "length": length,
    "tojson": lambda v: json.dumps(v, ensure_ascii=False),
}

# ---- parsing ---------------------------------------------------------------

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+~.,|()\[\]=]))""", re.DOTALL)
LITERALS = {"true": True, "false": False, "none": None}
WORDS = {"and", "or", "not", "in", "if", "else", *LITERALS}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def spoken(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.DOTALL)


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in {{{source}}}")
            kind = ("text", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, spoken(m[1]) if m[1] else int(m[2]) if m[2] else m[m.lastindex]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def must(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value in WORDS:
            raise TemplateError("expected a name")
        if value.startswith("_"):
            raise TemplateError("names cannot begin with an underscore")
        self.at += 1
        return value

    def ended(self, value: Any) -> Any:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return value

    def whole(self) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deeply")
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.must("else")
            value = Choice("if", (condition, value, self.whole()))
        self.depth -= 1
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Choice("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Choice("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        turns = 0
        while self.take("not"):
            turns += 1
        value = self.compared()
        for _ in range(turns):
            value = Apply("not", (value,))
        return value

    def compared(self) -> Any:
        value = self.joined()
        if how := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            return Apply(how, (value, self.joined()))
        if self.peek()[1] == "not" and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
            self.at += 2
            return Apply("not in", (value, self.joined()))
        return value

    def joined(self) -> Any:
        value = self.filtered()
        while how := self.take("+", "~"):
            value = Apply(how, (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.single()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.whole())
                self.must("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                value = Apply("|" + name, (value, *self.listed("(", ")")))
            else:
                return value

    def listed(self, opening: str, closing: str) -> list:
        """Expressions between two signs, or none where the first sign is not there."""
        parts: list = []
        if self.take(opening):
            while not self.take(closing):
                if parts:
                    self.must(",")
                parts.append(self.whole())
        return parts

    def single(self) -> Any:
        kind, value = self.peek()
        if kind in ("text", "number"):
            self.at += 1
            return Const(value)
        if self.take("-"):
            kind, value = self.peek()
            if kind != "number":
                raise TemplateError("- stands before numbers only")
            self.at += 1
            return Const(-value)
        if word := self.take(*LITERALS):
            return Const(LITERALS[word])
        if self.take("("):
            value = self.whole()
            self.must(")")
            return value
        if kind == "sign" and value == "[":
            return Apply("list", tuple(self.listed("[", "]")))
        return Name(self.name())


def expression(source: str) -> Any:
    parser = Expression(source)
    return parser.ended(parser.whole())


def tags(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "output" | "block", content) in order, with "-" trimming done."""
    at, trim = 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        before, after = (m[1], m[3]) if m[2] is not None else (m[4], m[6]) if m[5] is not None else (m[7], m[8])
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if before else text
        if m[2] is not None:
            yield "output", m[2]
        elif m[5] is not None:
            yield "block", m[5].strip()
        at, trim = m.end(), bool(after)
    rest = source[at:]
    yield "text", rest.lstrip() if trim else rest


class Statements:
    """A parser of nested blocks."""

    def __init__(self, source: str) -> None:
        self.tags = tags(source)
        self.depth = 0

    def block(self, *closing: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of ``closing``, and that tag."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deeply")
        nodes: list = []
        for kind, content in self.tags:
            if kind == "text":
                if "{{" in content or "{%" in content or "{#" in content:
                    raise TemplateError("a tag is not closed")
                nodes.append(Text(content))
            elif kind == "output":
                nodes.append(Output(expression(content)))
            else:
                word, _, rest = content.partition(" ")
                if word in closing:
                    self.depth -= 1
                    return tuple(nodes), content
                nodes.append(self.statement(word, rest))
        if closing:
            raise TemplateError(f"{closing[-1]} is missing")
        return tuple(nodes), ""

    def statement(self, word: str, rest: str) -> Any:
        if word == "for":
            parser = Expression(rest)
            name = parser.name()
            parser.must("in")
            over = parser.ended(parser.whole())
            return For(name, over, self.block("endfor")[0])
        if word == "if":
            cases: list = []
            condition = expression(rest)
            while True:
                block, tag = self.block("elif", "else", "endif")
                cases.append((condition, block))
                if tag == "endif":
                    return If(tuple(cases))
                if tag == "else":
                    cases.append((Const(True), self.block("endif")[0]))
                    return If(tuple(cases))
                condition = expression(tag.partition(" ")[2])
        if word == "set":
            parser = Expression(rest)
            name = parser.name()
            parser.must("=")
            return Set(name, parser.ended(parser.whole()))
        if word == "generation":
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")


def parse(source: str) -> tuple:
    return Statements(source).block()[0]


# ---- folding ---------------------------------------------------------------


def folded(node: Any) -> Any:
    """The expression with its constant parts evaluated."""
    if isinstance(node, Item):
        return folded(Apply("item", (node.of, node.key)))
    if isinstance(node, Apply):
        parts = tuple(map(folded, node.parts))
        if all(isinstance(p, Const) for p in parts):
            return Const(applied(node.how, [p.value for p in parts]))
        return Apply(node.how, parts)
    if isinstance(node, Choice):
        parts = tuple(map(folded, node.parts))
        if isinstance(parts[0], Const):
            first = bool(parts[0].value)
            if node.kind == "if":
                return parts[1] if first else parts[2]
            return parts[1] if first == (node.kind == "and") else parts[0]
        return Choice(node.kind, parts)
    return node


def applied(how: str, values: list) -> Any:
    try:
        return (FILTERS[how[1:]] if how.startswith("|") else PURE[how])(*values)
    except TypeError as e:
        raise TemplateError(f"{how}: {e}") from e


def folded_block(nodes: tuple) -> tuple:
    """The statements with constant texts joined and branches that are never taken left out."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = folded(node.value)
            add(Text(as_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, Set):
            add(Set(node.name, folded(node.value)))
        elif isinstance(node, For):
            add(For(node.name, folded(node.over), folded_block(node.block)))
        elif isinstance(node, Generation):
            add(Generation(folded_block(node.block)))
        elif isinstance(node, If):
            cases = []
            for condition, block in node.cases:
                condition = folded(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, folded_block(block)))
                if isinstance(condition, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                for inner in cases[0][1]:
                    add(inner)
            elif cases:
                add(If(tuple(cases)))
        else:
            add(node)
    return tuple(out)


# ---- closures --------------------------------------------------------------

Scope = dict[str, Any]


def value_of(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        held = node.value
        return lambda scope: held
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    parts = list(map(value_of, node.parts))
    if isinstance(node, Choice):
        a, b = parts[:2]
        if node.kind == "and":
            return lambda scope: a(scope) and b(scope)
        if node.kind == "or":
            return lambda scope: a(scope) or b(scope)
        c = parts[2]
        return lambda scope: b(scope) if a(scope) else c(scope)
    how = node.how
    return lambda scope: applied(how, [p(scope) for p in parts])


def followed(items: Any) -> Iterator[tuple[Any, bool]]:
    """Each item of a stream, and whether it is the last one."""
    if not hasattr(items, "__iter__") or isinstance(items, (str, dict)):
        raise TemplateError("for takes a list")
    stream = iter(items)
    for item in stream:
        for after in stream:
            yield item, False
            item = after
        yield item, True


def writer(nodes: tuple) -> Callable[[Scope], Iterator[Any]]:
    parts = list(map(statement, nodes))
    if len(parts) == 1:
        return parts[0]

    def write(scope: Scope) -> Iterator[Any]:
        for p in parts:
            yield from p(scope)

    return write


def statement(node: Any) -> Callable[[Scope], Iterator[Any]]:
    if isinstance(node, Text):
        whole = (node.text,)
        return lambda scope: iter(whole)
    if isinstance(node, Output):
        value = value_of(node.value)
        return lambda scope: iter((as_text(value(scope)),))
    if isinstance(node, Set):
        held, name = value_of(node.value), node.name

        def put(scope: Scope) -> Iterator[Any]:
            scope[name] = held(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        inner = writer(node.block)
        return lambda scope: itertools.chain((BEGIN,), inner(scope), (END,))
    if isinstance(node, If):
        cases = [(value_of(c), writer(b)) for c, b in node.cases]

        def choose(scope: Scope) -> Iterator[Any]:
            return next((write(scope) for c, write in cases if c(scope)), iter(()))

        return choose
    over, body, name = value_of(node.over), writer(node.block), node.name

    def repeat(scope: Scope) -> Iterator[Any]:
        for i, (item, last) in enumerate(followed(over(scope))):
            loop = {"index": i + 1, "index0": i, "first": i == 0, "last": last}
            yield from body({**scope, name: item, "loop": loop})

    return repeat


@lru_cache(maxsize=16)
def compiled(source: str) -> Callable[[Scope], Iterator[Any]]:
    """A function from the template's names to the texts it writes and the marks between them."""
    return writer(folded_block(parse(source)))
