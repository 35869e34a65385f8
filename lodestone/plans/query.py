"""The query language: words, "phrases", (groups), +must, -not, field:word, boosts (word^2), AND, OR and NOT.

Words are alternatives unless marked.  AND makes both of its sides required, NOT excludes what follows it.  What
is no query raises QueryError: an open quote or group, an empty group, a mark or operator without its word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from lodestone.operators.search import FIELDS

_TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<sign>[+-])(?=\S)|(?P<open>(?:(?P<gfield>[A-Za-z_]+):)?\()|(?P<close>\))|(?:(?P<pfield>[A-Za-z_]+):)?"(?P<phrase>[^"]*)(?P<end>"?)|(?P<boost>\^\d+(?:\.\d+)?)|(?P<word>[^\s"()^]+|\^)'
)


class QueryError(ValueError):
    """The text is no query."""


@dataclass(frozen=True)
class Clause:
    text: str
    phrase: bool = False
    field: str | None = None
    occur: str = "should"  # should, must or not
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    clauses: tuple[Clause | Group, ...]
    occur: str = "should"
    boost: float = 1.0


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise QueryError(f"no query from here on: {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def clauses(self, field: str | None, inside: bool) -> list[Clause | Group]:
        out: list[Clause | Group] = []
        pending = sign = None
        while self.at < len(self.tokens):
            m = self.tokens[self.at]
            self.at += 1
            kind = m.lastgroup
            if kind == "space":
                continue
            if kind == "sign":
                if sign:
                    raise QueryError("two marks before one word")
                sign = m["sign"]
                continue
            if kind == "close":
                if not inside or pending or sign:
                    raise QueryError("a group ends where none is open, or after an operator")
                if not out:
                    raise QueryError("a group is empty")
                return out
            if kind == "boost":
                if not out or self.tokens[self.at - 2].lastgroup == "space":
                    raise QueryError(f"{m[0]} boosts nothing")
                out[-1] = replace(out[-1], boost=float(m["boost"][1:]))
                continue
            if kind == "open":
                found: Clause | Group | None = Group(tuple(self.clauses(self._field(m["gfield"]) or field, True)))
            elif m["phrase"] is not None:
                if not m["end"]:
                    raise QueryError("a quote is not closed")
                found = Clause(m["phrase"].strip(), True, self._field(m["pfield"]) or field) if m["phrase"].strip() else None
            else:
                word = m["word"]
                if word in ("+", "-", "^"):
                    raise QueryError(f"{word} stands alone")
                if not sign and word in ("AND", "OR", "NOT"):
                    if pending and not (word == "NOT" and pending == "AND") or (not out and word != "NOT"):
                        raise QueryError(f"{word} has nothing before it")
                    if word == "AND" and out[-1].occur == "should":
                        out[-1] = replace(out[-1], occur="must")
                    pending = word
                    continue
                own, colon, rest = word.partition(":")
                if colon and own in FIELDS and not rest.startswith(":"):
                    if not rest:
                        raise QueryError(f"{word} has no word")
                    found = Clause(rest, False, own)
                else:  # a colon without a field belongs to the word
                    found = Clause(word, False, field)
            if found is not None:
                occur = {"+": "must", "-": "not"}.get(sign) or {"AND": "must", "NOT": "not"}.get(pending, "should")
                out.append(replace(found, occur=occur))
            pending = sign = None
        if inside:
            raise QueryError("a group is not closed")
        if pending or sign:
            raise QueryError(f"{pending or sign} has nothing after it")
        return out

    @staticmethod
    def _field(name: str | None) -> str | None:
        if name is not None and name not in FIELDS:
            raise QueryError(f"{name} is no field; use one of {', '.join(FIELDS)}")
        return name


def parse(query: str) -> list[Clause | Group]:
    """Clauses in order."""
    return _Parser(query).clauses(None, False)
