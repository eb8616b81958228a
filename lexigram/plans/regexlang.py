"""The small regular-expression language of a query's first token.

Letters, ``.``, ``[abc]``, ``(..)``, ``?``, ``*``, ``+`` and ``|``, which binds tighter than
sequence: ``foo|bar`` means ``fo`` then ``o`` or ``b`` then ``ar``.  A pattern is compiled to
a Java expression for the exact match and to literals and prefixes that bound the first
token, which Parquet's filters understand.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond so many candidates the common prefix is taken.
MOST_CANDIDATES = 200


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Letter:
    char: str


@dataclass(frozen=True)
class AnyChar:
    pass


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    options: tuple


@dataclass(frozen=True)
class Repeat:
    part: object
    sign: str


def parse(pattern: str) -> Seq:
    """The pattern's tree; raises :class:`PatternError` for anything outside the language."""
    at = 0

    def fail(why: str) -> PatternError:
        return PatternError(f"{pattern!r}, character {at + 1}: {why}")

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def atom() -> object:
        nonlocal at
        c = peek()
        at += 1
        if c == "(":
            inner = sequence()
            if peek() != ")":
                raise fail("a bracket is open")
            at += 1
            return inner
        if c == "[":
            letters = []
            while peek() and peek() != "]":
                if not peek().isalpha():
                    raise fail("only letters stand in a class")
                letters.append(Letter(peek()))
                at += 1
            if not peek() or not letters:
                raise fail("the class is open or empty")
            at += 1
            return Alt(tuple(letters))
        if c == ".":
            return AnyChar()
        if c.isalpha():
            return Letter(c)
        at -= 1
        raise fail(f"unexpected {c!r}" if c else "the pattern ends")

    def repeated() -> object:
        nonlocal at
        part = atom()
        while peek() and peek() in "?*+":
            part = Repeat(part, peek())
            at += 1
        return part

    def alternatives() -> object:
        nonlocal at
        options = [repeated()]
        while peek() == "|":
            at += 1
            options.append(repeated())
        return options[0] if len(options) == 1 else Alt(tuple(options))

    def sequence() -> Seq:
        parts = [alternatives()]
        while peek() and peek() != ")":
            parts.append(alternatives())
        return Seq(tuple(parts))

    tree = sequence()
    if at < len(pattern):
        raise fail("a bracket closes nothing")
    return tree


def java(node: object) -> str:
    """The same language as a Java regular expression, without anchors."""
    if isinstance(node, Letter):
        return node.char
    if isinstance(node, AnyChar):
        return "."
    if isinstance(node, Seq):
        return "".join(java(p) for p in node.parts)
    if isinstance(node, Alt):
        return "(?:" + "|".join(java(o) for o in node.options) + ")"
    return f"(?:{java(node.part)}){node.sign}"


def candidates(node: object) -> list[str]:
    """Literals and ``prefix*`` of which every match is one; in order, none under another.

    Repeats of more than one are widened to a prefix, so no match is lost.
    """

    def extend(done: list[tuple[str, bool]], node: object) -> list[tuple[str, bool]]:
        if isinstance(node, Seq):
            return reduce(extend, node.parts, done)
        out = []
        for text, open_ in done:
            if open_:
                out.append((text, True))
            elif isinstance(node, Letter):
                out.append((text + node.char, False))
            elif isinstance(node, AnyChar):
                out.append((text, True))
            elif isinstance(node, Alt):
                for option in node.options:
                    out += extend([(text, False)], option)
            elif node.sign == "?":
                out += [*extend([(text, False)], node.part), (text, False)]
            elif node.sign == "+":
                out += [(t, True) for t, _ in extend([(text, False)], node.part)]
            else:
                out.append((text, True))
        if len(out) > MOST_CANDIDATES:
            first, last = min(t for t, _ in out), max(t for t, _ in out)
            k = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
            return [(first[:k], True)]
        return out

    found = list(dict.fromkeys(extend([("", False)], node)))
    prefixes = {t for t, o in found if o}
    covered = lambda t, o: any(t.startswith(p) and (not o or p != t) for p in prefixes)
    return [t + "*" * o for t, o in found if not covered(t, o)]


def candidate_predicate(column: str, found: list[str]) -> Column:
    """Equalities and prefixes, which reach the Parquet scan."""
    if "*" in found:
        return F.lit(True)
    literals = [c for c in found if not c.endswith("*")]
    parts = [F.col(column).startswith(c[:-1]) for c in found if c.endswith("*")]
    if literals:
        parts.append(F.col(column).isin(*literals) if len(literals) > 1 else F.col(column) == literals[0])
    return reduce(lambda a, b: a | b, parts)
