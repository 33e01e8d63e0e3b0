"""Parser of the script language.

A script has statements ``name = op(args)`` or ``op(args)``, one a line, and
functions::

    function f(a, b)
        x = op(a, key=b)
    return x

Arguments are reals, integers, quoted strings, names or lists of strings in
braces; keywords follow positional ones. Empty argument lists and empty braces
are accepted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Literal = float | int | str | list


class Name(str):
    """A reference to a variable."""


@dataclass(frozen=True)
class Argument:
    value: Literal | Name
    keyword: str | None = None


@dataclass(frozen=True)
class Statement:
    op: str
    args: tuple[Argument, ...]
    target: str | None = None

    def __str__(self) -> str:
        def text(v) -> str:
            if isinstance(v, Name):
                return str(v)
            if isinstance(v, list):
                return "{" + ", ".join(f'"{x}"' for x in v) + "}"
            return f'"{v}"' if isinstance(v, str) else str(v)

        args = ", ".join((f"{a.keyword}=" if a.keyword else "") + text(a.value) for a in self.args)
        return (f"{self.target} = " if self.target else "") + f"{self.op}({args})"


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[str, ...]
    body: tuple[Statement, ...]
    result: str | None


@dataclass
class Script:
    statements: list[Statement] = field(default_factory=list)
    functions: dict[str, Function] = field(default_factory=dict)


class SyntaxProblem(ValueError):
    """Text that isn't a script, with its offset."""


_SPACE = re.compile(r"[ \t]*")
_LINE = re.compile(r"[ \t]*(?:\r?\n[ \t]*)+|[ \t]*$")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_REAL = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+")
_INT = re.compile(r"[+-]?\d+")
_STRING = re.compile(r'"([^"]*)"')


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, wanted: str) -> SyntaxProblem:
        return SyntaxProblem(f"expected {wanted} at offset {self.at}: {self.text[self.at : self.at + 20]!r}")

    def take(self, rx: re.Pattern) -> re.Match | None:
        self.at = _SPACE.match(self.text, self.at).end()  # type: ignore[union-attr]
        m = rx.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def mark(self, c: str) -> bool:
        return self.take(re.compile(re.escape(c))) is not None

    def need(self, c: str) -> None:
        if not self.mark(c):
            raise self.fail(repr(c))

    def name(self) -> str:
        m = self.take(_NAME)
        if not m:
            raise self.fail("a name")
        return m[0]

    def end_of_line(self) -> None:
        m = _LINE.match(self.text, self.at)
        if not m:
            raise self.fail("the end of the line")
        self.at = m.end()

    def value(self) -> Literal | Name:
        if m := self.take(_REAL):
            return float(m[0])
        if m := self.take(_INT):
            return int(m[0])
        if m := self.take(_STRING):
            return m[1]
        if self.mark("{"):
            out: list[str] = []
            while not self.mark("}"):
                if out:
                    self.need(",")
                m = self.take(_STRING)
                if not m:
                    raise self.fail("a string")
                out.append(m[1])
            return out
        return Name(self.name())

    def argument(self) -> Argument:
        at = self.at
        m = self.take(_NAME)
        if m and self.mark("="):
            return Argument(self.value(), m[0])
        self.at = at
        return Argument(self.value())

    def statement(self) -> Statement:
        first, target = self.name(), None
        if self.mark("="):
            target, first = first, self.name()
        self.need("(")
        args: list[Argument] = []
        while not self.mark(")"):
            if args:
                self.need(",")
            args.append(self.argument())
        self.end_of_line()
        return Statement(first, tuple(args), target)

    def function(self) -> Function:
        name = self.name()
        self.need("(")
        params: list[str] = []
        while not self.mark(")"):
            if params:
                self.need(",")
            params.append(self.name())
        self.end_of_line()
        body: list[Statement] = []
        while not self.take(re.compile(r"return\b")):
            body.append(self.statement())
        m = self.take(_NAME)
        self.end_of_line()
        return Function(name, tuple(params), tuple(body), m[0] if m else None)

    def script(self) -> Script:
        out = Script()
        if m := _LINE.match(self.text, self.at):
            self.at = m.end()
        while self.at < len(self.text):
            at = self.at
            if self.take(re.compile(r"function[ \t]+(?=[A-Za-z])")):
                f = self.function()
                out.functions[f.name] = f  # the last definition counts
            else:
                self.at = at
                out.statements.append(self.statement())
        return out


def parse(text: str) -> Script:
    """A script's statements and functions; SyntaxProblem where it isn't one."""
    return _Parser(text).script()
