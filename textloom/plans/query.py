"""Boolean query strings: text to syntax tree to one boolean Column.

Grammar: OR < AND < NOT, parentheses, words, and DATE[l,r] / APPEARED[l,r] / VALID[l,r] with
8-digit bounds. NOT may be repeated. Malformed queries raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Dates:
    kind: str
    low: str
    high: str


@dataclass(frozen=True)
class Not:
    arg: object


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


_INTERVAL = re.compile(r"(DATE|APPEARED|VALID)\[(\d{8}),(\d{8})\]", re.I)
_LETTERS = r"[a-zA-Zа-яА-ЯёЁ0-9_À-ɏ]+"
_WHOLE = re.compile(rf"\s*(?:(?P<dates>(?:DATE|APPEARED|VALID)\[\d{{8}},\d{{8}}\])|(?P<par>[()])|(?P<word>{_LETTERS}))", re.I)
#: Operators also match the start of a longer word: ``order`` reads as OR, ``der``.
_LOOSE = re.compile(rf"\s*(?:(?P<dates>(?:DATE|APPEARED|VALID)\[\d{{8}},\d{{8}}\])|(?P<par>[()])|(?P<word>AND|OR|NOT|{_LETTERS}))", re.I)


def tokenize(query: str, loose_operators: bool = False) -> list[tuple[str, str]]:
    """Pairs of kind ('op', 'par', 'word', 'dates') and text.

    ``loose_operators`` restores the reading in which an operator needs no word boundary.
    Characters that start no token are skipped.
    """
    pattern, out, at = (_LOOSE if loose_operators else _WHOLE), [], 0
    while at < len(query):
        m = pattern.match(query, at)
        if not m:
            at += 1
            continue
        at, kind = m.end(), m.lastgroup
        text = m[kind]
        if kind == "word" and text.upper() in ("AND", "OR", "NOT"):
            kind, text = "op", text.upper()
        out.append((kind, text))
    return out


def parse(query: str, loose_operators: bool = False) -> object:
    """The syntax tree of a query."""
    toks, at = tokenize(query, loose_operators), 0

    def peek() -> tuple[str, str] | None:
        return toks[at] if at < len(toks) else None

    def operand() -> object:
        nonlocal at
        tok = peek()
        if tok is None:
            raise ValueError("query ends where an operand is needed")
        at += 1
        if tok == ("op", "NOT"):
            return Not(operand())
        if tok == ("par", "("):
            inner = chain(1)
            if peek() != ("par", ")"):
                raise ValueError("unclosed parenthesis")
            at += 1
            return inner
        if tok[0] == "word":
            return Word(tok[1])
        if tok[0] == "dates":
            kind, low, high = _INTERVAL.fullmatch(tok[1]).groups()
            return Dates(kind.upper(), low, high)
        raise ValueError(f"unexpected {tok[1]!r}")

    def chain(level: int) -> object:
        nonlocal at
        if level > 2:
            return operand()
        name = {1: "OR", 2: "AND"}[level]
        left = chain(level + 1)
        while peek() == ("op", name):
            at += 1
            left = Both(name, left, chain(level + 1))
        return left

    if not toks:
        raise ValueError("empty query")
    tree = chain(1)
    if at < len(toks):
        raise ValueError(f"unexpected {toks[at][1]!r}")
    return tree


def words_of(tree: object) -> set[str]:
    if isinstance(tree, Word):
        return {tree.text}
    if isinstance(tree, Not):
        return words_of(tree.arg)
    return words_of(tree.left) | words_of(tree.right) if isinstance(tree, Both) else set()


def interval(d: Dates) -> Column:
    """The predicate of a date leaf over columns date, start_date, end_date (strings YYYYMMDD)."""
    date, start, end = F.col("date"), F.col("start_date"), F.col("end_date")
    if d.kind == "DATE":
        found = date.between(d.low, d.high)
    elif d.kind == "APPEARED":
        found = start.between(d.low, d.high)
    else:  # valid at some time in [low, high]; a row without start is never valid
        found = start.isNotNull() & (start <= d.high) & (end.isNull() | (end >= d.low))
    return F.coalesce(found, F.lit(False))


def to_column(tree: object, word: Callable[[str], Column]) -> Column:
    """One boolean Column; ``word`` gives the Column of a word leaf."""
    if isinstance(tree, Word):
        return word(tree.text)
    if isinstance(tree, Dates):
        return interval(tree)
    if isinstance(tree, Not):
        return ~to_column(tree.arg, word)
    left, right = to_column(tree.left, word), to_column(tree.right, word)
    return left & right if tree.op == "AND" else left | right
