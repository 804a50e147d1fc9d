"""The query language: words, AND, OR, NOT and parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be read or can't be run."""


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class And:
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Not:
    part: Query


Query = Term | And | Or | Not

_LEX = re.compile(r"[()]|\w+")
_OPERATORS = {"and", "or", "not"}


def lex(query: str) -> list[str]:
    """Parentheses, operators in capitals, and words in lower case; anything else separates."""
    found = (w if w in "()" else w.lower() for w in _LEX.findall(query))
    return [w.upper() if w in _OPERATORS else w for w in found]


def parse(query: str) -> Query:
    """The tree of a query.

    OR binds least, then AND, which may be left out between neighbours, then
    one NOT.  Chains of the same operator are one node.
    """
    words = lex(query)
    if not words:
        raise QueryError("empty query")
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise QueryError("the query ends too early")
        at += 1
        return words[at - 1]

    def either() -> Query:
        out = both()
        while peek() == "OR":
            take()
            right = both()
            out = Or((*out.parts, right)) if isinstance(out, Or) else Or((out, right))
        return out

    def both() -> Query:
        out = unary()
        while (word := peek()) is not None and word not in ("OR", ")"):
            if word == "AND":
                take()
            right = unary()
            out = And((*out.parts, right)) if isinstance(out, And) else And((out, right))
        return out

    def unary() -> Query:
        if peek() == "NOT":
            take()
            return Not(primary())
        return primary()

    def primary() -> Query:
        word = take()
        if word == "(":
            out = either()
            if (close := take()) != ")":
                raise QueryError(f"expected ) but found {close}")
            return out
        if word in ("AND", "OR", "NOT", ")"):
            raise QueryError(f"unexpected {word}")
        return Term(word)

    out = either()
    if at < len(words):
        raise QueryError(f"unexpected {words[at]} at place {at}")
    return out


def words_of(query: Query) -> list[str]:
    """All words of a query outside NOT, with repeats."""
    if isinstance(query, Term):
        return [query.text]
    if isinstance(query, Not):
        return []
    return [w for p in query.parts for w in words_of(p)]


def all_words(query: Query) -> list[str]:
    """All words of a query."""
    if isinstance(query, Term):
        return [query.text]
    return all_words(query.part) if isinstance(query, Not) else [w for p in query.parts for w in all_words(p)]
