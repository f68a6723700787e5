"""Search expressions: what a user types becomes words and phrases, and a scope becomes categories."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import plain, python_words


class QueryError(ValueError):
    """A request that cannot be answered as it stands."""


@dataclass(frozen=True)
class SearchPlan:
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


#: Double quotes, single quotes at the beginning of a word, or anything up to white space.
_PART = re.compile(r"\"(?P<double>[^\"]+)\"|'(?P<single>[^']+)'|(?P<bare>\S+)")

#: Categories of the documents table in order; a stored corpus has its own.
CATEGORIES = ("en", "de", "fr", "es")
LIMITS = {"limit": (1, 1000), "context": (0, 10**9), "per_query_limit": (1, 1000), "context_passages": (0, 12), "per_token_limit": (1, 10), "max_distance": (1, 8), "max_per_document": (0, 10**9)}
MOST_QUERIES = 32


def within(**values: int) -> None:
    """Checks arguments against their bounds."""
    for name, value in values.items():
        low, high = LIMITS[name]
        if not low <= value <= high:
            raise QueryError(f"{name} must be between {low} and {high}")


def parse(text: str) -> SearchPlan:
    """Quoted runs of two words or more are phrases whose words are also terms; terms count once, phrases as often as typed."""
    words: dict[str, None] = {}
    phrases = []
    for part in _PART.finditer(text):
        found = python_words(part[part.lastgroup])
        if part.lastgroup != "bare" and len(found) > 1:
            phrases.append(tuple(found))
        words.update(dict.fromkeys(found))
    if not words:
        raise QueryError("a query needs a word to look for")
    return SearchPlan(tuple(words), tuple(phrases))


#: What a user writes, or the categories that it stands for (none: all).
Scope = str | tuple[str, ...] | None


def scope(text: Scope, categories: tuple[str, ...] = CATEGORIES, default: tuple[str, ...] | None = None) -> tuple[str, ...] | None:
    """The categories of a scope in their order; none for ``all``, which filters nothing. ``default`` are the first two
    unless named. Categories that are already found stay as they are."""
    if not isinstance(text, str):
        return text
    folded = text.strip().casefold()
    if folded == "all":
        return None
    if folded in ("default", "both"):
        return categories[:2] if default is None else default
    asked = {part.strip() for part in re.split(r"[+,]", folded)}
    if not asked <= {c.casefold() for c in categories}:
        raise QueryError(f"unknown scope: {text}")
    return tuple(c for c in categories if c.casefold() in asked)


def distinct_queries(queries: list[str]) -> list[str]:
    """Queries without those that equal an earlier one but for case, marks and white space."""
    first: dict[str, str] = {}
    for q in queries:
        key = " ".join(plain(q).split())
        if key:
            first.setdefault(key, q.strip())
    if not 1 <= len(first) <= MOST_QUERIES:
        raise QueryError(f"between 1 and {MOST_QUERIES} different queries are needed")
    return list(first.values())


def page_range(text: str, pages: int) -> list[int]:
    """``1-3,8``, ``all`` or ``*`` as sorted page numbers."""
    if text.strip().lower() in ("all", "*"):
        return list(range(1, pages + 1))
    found: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise QueryError(f"not a page range: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if not 1 <= low <= high <= pages:
            raise QueryError(f"pages must lie between 1 and {pages}: {part.strip()}")
        found.update(range(low, high + 1))
    return sorted(found)
