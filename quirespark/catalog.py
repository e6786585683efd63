"""The index fields: what each is, and the column that holds it."""

from __future__ import annotations

from dataclasses import dataclass

from quirespark.errors import UnknownIndexField, WrongFieldType


@dataclass(frozen=True)
class IndexField:
    """``column`` has the raw value; keyword fields are compared by ``column`` with ``_norm`` behind it."""

    name: str
    kind: str
    column: str
    aggregatable: bool = False
    sortable: bool = False

    @property
    def tokenized(self) -> bool:
        return self.kind == "Text"

    @property
    def keyword(self) -> bool:
        return self.kind == "UntokenizedText"

    @property
    def compared(self) -> str:
        return self.column + "_norm" if self.keyword else self.column


FIELDS = {
    f.name: f
    for f in (
        IndexField("Reference", "String", "doc_ref", sortable=True),
        IndexField("Revision", "String", "rev"),
        IndexField("Author", "UntokenizedText", "author", aggregatable=True),
        IndexField("AuthorEnglish", "UntokenizedText", "author_en", aggregatable=True),
        IndexField("Title", "Text", "title"),
        IndexField("TitleEnglish", "Text", "title_en"),
        IndexField("Volume", "UntokenizedText", "volume"),
        IndexField("Publisher", "UntokenizedText", "publisher"),
        IndexField("PublicationYear", "UntokenizedText", "pub_year_raw"),
        IndexField("PublicationYearAsNumber", "Integer", "pub_year", sortable=True),
        IndexField("Text", "Text", "text"),
        IndexField("IndexTime", "Instant", "index_time"),
        IndexField("URL", "String", "url"),
        IndexField("OCRSoftware", "String", "ocr_software"),
        IndexField("Collection", "MultiString", "collections"),
    )
}


def field(name: str) -> IndexField:
    try:
        return FIELDS[name]
    except KeyError:
        raise UnknownIndexField(f"Unknown IndexField: {name}") from None


def of_kind(name: str, *kinds: str) -> IndexField:
    found = field(name)
    if found.kind not in kinds:
        raise WrongFieldType(f"{name} is {found.kind}, not one of {', '.join(kinds)}")
    return found
