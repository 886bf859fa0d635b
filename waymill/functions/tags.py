"""The tag filter language: expressions become Columns over the tags array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StringMatcher:
    """kind: any, equal, list, prefix or substring; words: what it compares with."""

    kind: str
    words: tuple[str, ...] = ()

    def matches(self, value: Column) -> Column:
        if self.kind == "any":
            return F.lit(True)
        if self.kind == "list":
            return value.isin(*self.words)
        word = F.lit(self.words[0])
        if self.kind == "equal":
            return value == word
        return F.startswith(value, word) if self.kind == "prefix" else F.contains(value, word)


@dataclass(frozen=True)
class TagMatcher:
    """Matches single tags. value None: any value; negated: a tag of that key with another value."""

    key: StringMatcher
    value: StringMatcher | None = None
    negated: bool = False

    def matches(self, tag: Column) -> Column:
        key = self.key.matches(tag["k"])
        if self.value is None:
            return key
        value = self.value.matches(tag["v"])
        return key & (~value if self.negated else value)

    def any_of(self, tags: Column | str = "tags") -> Column:
        return F.exists(tags, self.matches)


@dataclass(frozen=True)
class TagFilter:
    """A matcher for objects of some types: letters of n, w, r and a (areas)."""

    types: frozenset[str]
    matcher: TagMatcher


def string_matcher(text: str) -> StringMatcher:
    """``*`` any, ``abc*`` a prefix, ``*abc`` or ``*abc*`` a part, ``a,b`` one of a list, else the text itself."""
    text = text.strip(" ")
    if text == "*":
        return StringMatcher("any")
    if text.startswith("*"):
        return StringMatcher("substring", (text[1:].removesuffix("*"),))
    if text.endswith("*"):
        return StringMatcher("prefix", (text[:-1],))
    if "," in text:
        return StringMatcher("list", tuple(part.strip(" ") for part in text.split(",")))
    return StringMatcher("equal", (text,))


def tag_matcher(text: str) -> TagMatcher:
    """``key``, ``key=value`` or ``key!=value``; keys and values are string matchers."""
    key, has_value, value = text.partition("=")
    if not has_value:
        return TagMatcher(string_matcher(key))
    negated = key.endswith("!")
    return TagMatcher(string_matcher(key.removesuffix("!")), string_matcher(value), negated)


def tag_filter(text: str) -> TagFilter:
    """``TYPES/expression``; without types (or with none before the slash) nodes, ways and relations."""
    types, slash, rest = text.partition("/")
    if not slash:
        return TagFilter(frozenset("nwr"), tag_matcher(text))
    unknown = set(types) - set("nwra")
    if unknown:
        raise ValueError(f"Unknown object type {min(unknown)!r}; n, w, r and a are allowed")
    return TagFilter(frozenset(types or "nwr"), tag_matcher(rest))


def read_expressions(lines: list[str]) -> list[str]:
    """Expressions of a file, one a line; blank lines and what begins with # are left out."""
    lines = [line.rstrip("\r\n").partition("#")[0] for line in lines]
    return [line for line in lines if line.strip(" ")]


def any_match(matchers: list[TagMatcher], tag: Column) -> Column:
    """Whether one of the matchers fits the tag."""
    found = F.lit(False)
    for m in matchers:
        found = found | m.matches(tag)
    return found
