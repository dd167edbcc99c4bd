"""The text query: words that must occur (as substrings), alternatives, exclusions and quoted phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = re.compile("'([^']+)'")


@dataclass(frozen=True)
class Token:
    """``kind``: exact, not, or, and. ``words``: one, or the alternatives of an ``or``."""

    kind: str
    words: tuple[str, ...]

    def column(self, lowered: Column) -> Column:
        hits = [F.contains(lowered, F.lit(w)) for w in self.words]
        return ~hits[0] if self.kind == "not" else reduce(Column.__or__, hits)


def tokens(query: str) -> list[Token]:
    """Quoted phrases first; then the rest, cut at white space. An exclamation mark excludes what follows it, a bar parts
    alternatives; empty parts are dropped. A query without tokens matches everything."""
    found = [Token("exact", (m.lower(),)) for m in _QUOTED.findall(query)]
    for part in _QUOTED.sub("", query).split():
        kind = "not" if part[0] == "!" else "or" if "|" in part else "and"
        words = {"not": [part[1:]], "or": part.split("|"), "and": [part]}[kind]
        words = tuple(w.lower() for w in words if w)
        if words:
            found.append(Token(kind, words))
    return found


def matches(caption: Column, query: str) -> Column:
    """Whether a caption matches; a null caption counts as empty. Never null."""
    lowered = F.lower(F.coalesce(caption, F.lit("")))
    return reduce(Column.__and__, [t.column(lowered) for t in tokens(query)], F.lit(True))


def search(entries: DataFrame, query: str, limit: int | None = None, caption: str = "caption", ordinal: str = "ordinal") -> DataFrame:
    """The matching entries; with a limit the first ones in the catalogue's order. A blank query matches all."""
    found = entries.where(matches(F.col(caption), query)) if query.strip() else entries
    return found if limit is None else found.orderBy(ordinal).limit(limit)


def holds_word(caption: Column, word: str) -> Column:
    """Whether the word is one of the caption's content words (a whole word, unlike in a query)."""
    from cinegrid.functions.scalars import content_words

    return F.array_contains(content_words(caption), word.lower())
