"""Keyword dictionaries and code sets as data, matched with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_keyword(label: Column, words: Iterable[str]) -> Column:
    """Case-insensitive "label contains one of the words"."""
    return F.lower(label).rlike("|".join(re.escape(w.lower()) for w in words))


def first_class(label: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first class with a matching keyword, else NULL."""
    chain = None
    for name, words in classes:
        hit = any_keyword(label, words)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


@dataclass(frozen=True)
class CodeRule:
    """Codes of one version that stand for an event type.

    ``prefixes`` match the start of the code, ``exact`` the whole code.
    """

    event_type: str
    version: int
    prefixes: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()

    def matches(self, code: Column, version: Column, normalize: bool = False) -> Column:
        strip = (lambda s: s.replace(".", "")) if normalize else (lambda s: s)
        if normalize:
            code = F.regexp_replace(code, r"\.", "")
        tests = [code.startswith(strip(p)) for p in self.prefixes]
        if self.exact:
            tests.append(code.isin([strip(e) for e in self.exact]))
        return (version == self.version) & reduce(lambda a, b: a | b, tests)


def code_event_types(
    rules: Sequence[CodeRule], code: Column, version: Column, normalize: bool = False
) -> Column:
    """Array of the event types a dictionary row stands for (may be empty)."""
    types = sorted({r.event_type for r in rules})
    flags = []
    for t in types:
        hit = reduce(
            lambda a, b: a | b,
            [r.matches(code, version, normalize) for r in rules if r.event_type == t],
        )
        flags.append(F.when(hit, F.lit(t)))
    return F.array_compact(F.array(*flags))
