"""The query algebra: criteria as values, their JSON, and requests turned into criteria."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from quirespark.errors import NoSearchCriteria


class Criterion:
    parts: tuple[Criterion, ...] = ()

    def contains(self) -> Contains | None:
        """The first Contains, depth first."""
        return next((x for p in self.parts if (x := p.contains())), None)

    def replaced(self, change: Callable[[str], str]) -> Criterion:
        """Every query string changed."""
        return self

    def as_dict(self) -> dict:
        own = {k: (list(v) if isinstance(v, tuple) else v) for k, v in self.__dict__.items() if k not in ("parts", "part")}
        if self.parts:
            own["parts"] = [p.as_dict() for p in self.parts]
        return {"type": type(self).__name__} | own

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), ensure_ascii=False, sort_keys=True)


@dataclass(frozen=True)
class MatchAll(Criterion):
    pass


@dataclass(frozen=True)
class Contains(Criterion):
    """``strict`` leaves synonyms out."""

    fields: tuple[str, ...]
    query: str
    strict: bool = False

    def contains(self) -> Contains:
        return self

    def replaced(self, change: Callable[[str], str]) -> Criterion:
        return replace(self, query=change(self.query))


@dataclass(frozen=True)
class ValueIn(Criterion):
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class StartsWith(Criterion):
    field: str
    prefix: str


@dataclass(frozen=True)
class GreaterThanOrEqualTo(Criterion):
    field: str
    value: int


@dataclass(frozen=True)
class LessThanOrEqualTo(Criterion):
    field: str
    value: int


class _Many(Criterion):
    def __init__(self, *parts: Criterion):
        object.__setattr__(self, "parts", tuple(parts))

    def replaced(self, change: Callable[[str], str]) -> Criterion:
        return type(self)(*(p.replaced(change) for p in self.parts))

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.parts == other.parts

    def __hash__(self) -> int:
        return hash((type(self), self.parts))


class Not(_Many):
    """Matches what its part does not, documents without the field included; its query strings are not highlighted."""

    def __init__(self, part: Criterion):
        super().__init__(part)


class And(_Many):
    pass


class Or(_Many):
    pass


def from_dict(told: dict) -> Criterion:
    kind = {x.__name__: x for x in (MatchAll, Contains, ValueIn, StartsWith, GreaterThanOrEqualTo, LessThanOrEqualTo, Not, And, Or)}[told["type"]]
    if issubclass(kind, _Many):
        return kind(*(from_dict(p) for p in told.get("parts", ())))
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items() if k != "type"})


def build(
    query: str | None = None,
    title: str | None = None,
    authors: tuple[str, ...] = (),
    include_authors: bool = True,
    doc_refs: tuple[str, ...] = (),
    from_year: int | None = None,
    to_year: int | None = None,
    ocr_software: str | None = None,
    strict: bool = False,
    match_all: bool = True,
) -> Criterion:
    """The criteria of a request: none match all documents or are an error, one stands alone, several must all hold."""
    found: list[Criterion] = []
    if query:
        found.append(Contains(("Text",), query, strict))
    if title:
        found.append(Contains(("Title", "TitleEnglish"), title, strict))
    if authors:
        wrote = Or(ValueIn("Author", tuple(authors)), ValueIn("AuthorEnglish", tuple(authors)))
        found.append(wrote if include_authors else Not(wrote))
    if doc_refs:
        found.append(ValueIn("Reference", tuple(doc_refs)))
    if from_year is not None:
        found.append(GreaterThanOrEqualTo("PublicationYearAsNumber", from_year))
    if to_year is not None:
        found.append(LessThanOrEqualTo("PublicationYearAsNumber", to_year))
    if ocr_software:
        found.append(ValueIn("OCRSoftware", (ocr_software,)))
    if not found:
        if match_all:
            return MatchAll()
        raise NoSearchCriteria("No search criteria")
    return found[0] if len(found) == 1 else And(*found)
