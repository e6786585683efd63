"""What differs by language: patterns, replacements, stop words, synonyms and hooks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import regex


def same(text: str) -> str:
    return text


@dataclass(frozen=True)
class Language:
    """``tokens`` cut words, in order of preference; ``normalise`` and ``query_replacements`` are applied in order."""

    locale: str = ""
    tokens: tuple[str, ...] = (r"[^\p{L}\p{M}\p{N}\s]",)
    normalise: tuple[tuple[str, str], ...] = ()
    query_replacements: tuple[tuple[str, str], ...] = ()
    stop_words: frozenset[str] = frozenset()
    synonyms: tuple[tuple[str, ...], ...] = ()
    right_to_left: bool = False
    #: Hooks: each gives a text for a text, or variants for a word. ``decompose`` comes before the normal forms on the search side.
    decompose: Callable[[str], str] = same
    simplify: Callable[[str], str] = same
    term_filter: Callable[[str], str] = same
    query_variants: Callable[[str], tuple[str, ...]] = field(default=lambda term: ())
    alternatives: Callable[[str], tuple[str, ...]] = field(default=lambda word: ())

    def with_synonyms(self, lines: tuple[tuple[str, ...], ...]) -> Language:
        """This language with the synonym lines of a file (see ``sources.alto.synonym_lines``) behind its own."""
        return replace(self, synonyms=(*self.synonyms, *lines))

    def normalised(self, text: str) -> str:
        for find, put in self.normalise:
            text = regex.sub(find, put, text)
        return text

    def synonyms_of(self, term: str) -> tuple[str, ...]:
        """All words that share a synonym line with ``term``, itself included; case does not matter."""
        found = [term]
        for line in self.synonyms:
            lowered = [self.normalised(w.lower()) for w in line]
            if term in lowered:
                found += [w for w in lowered if w not in found]
        return tuple(found)


#: Replacements in any query before it is parsed.
QUOTES = (("[„“”״‟«»]", '"'), ("[‘’‛]", "'"))

PLAIN = Language(query_replacements=QUOTES)

#: The patterns of English words.
ENGLISH = Language(
    locale="en",
    tokens=(r"\b(?:\p{Lu}\.)+", r"'s\b", r"'m\b", r"'re\b", r"'ve\b", r"'d\b", r"'ll\b", r"\b\w+n't\b", r"\b\d+(?:[.,]\d+)+\b", r"[=+$%€°£#<>]", r"\.\.\.", r"[\p{P}\p{S}]"),
    query_replacements=QUOTES,
)


def _without_quotes(term: str) -> str:
    """An abbreviation's quotes go when letters stand on both sides."""
    return regex.sub('["״]', "", term) if regex.fullmatch(r'(?:\p{L}\p{M}*)+(?:["״](?:\p{L}\p{M}*)+)+', term) else term


def decomposed(text: str) -> str:
    """Hebrew presentation forms as a letter and its marks, which the normal forms then treat alike."""
    return regex.sub("[\ufb1d-\ufb4f]", lambda m: unicodedata.normalize("NFKD", m[0]), text)


#: The YIVO romanisation, longer spellings first; final forms of letters.
LATIN = (
    ("tsh", "טש"),
    ("dzh", "דזש"),
    ("zh", "זש"),
    ("sh", "ש"),
    ("kh", "כ"),
    ("ts", "צ"),
    ("ay", "יי"),
    ("ey", "יי"),
    ("oy", "וי"),
    ("a", "א"),
    ("b", "ב"),
    ("d", "ד"),
    ("e", "ע"),
    ("f", "פ"),
    ("g", "ג"),
    ("h", "ה"),
    ("i", "י"),
    ("k", "ק"),
    ("l", "ל"),
    ("m", "מ"),
    ("n", "נ"),
    ("o", "א"),
    ("p", "פ"),
    ("r", "ר"),
    ("s", "ס"),
    ("t", "ט"),
    ("u", "ו"),
    ("v", "וו"),
    ("y", "י"),
    ("z", "ז"),
)
FINAL = {"כ": "ך", "מ": "ם", "נ": "ן", "פ": "ף", "צ": "ץ"}


def from_latin(term: str) -> tuple[str, ...]:
    """A romanised word in Hebrew letters; nothing for words of other letters. A vowel that begins a word gets its alef."""
    if not regex.fullmatch("[a-z]+", term):
        return ()
    out, at = [], 0
    while at < len(term):
        found = next(((latin, letters) for latin, letters in LATIN if term.startswith(latin, at)), None)
        if found is None:
            return ()
        out.append(found[1])
        at += len(found[0])
    if term[0] in "eiuy" and regex.match("ey|ay|oy|i|u", term):
        out.insert(0, "א")
    if len(out) > 1 and out[-1] in FINAL and not (out[-1] == "פ" and term.endswith("p")):
        out[-1] = FINAL[out[-1]]
    return ("".join(out),)


#: The patterns, normal forms, stop words and standard synonyms of Yiddish.
YIDDISH = Language(
    locale="yi",
    tokens=(
        r"\b(?:\p{L}[֑-ׇֽֿׁׂ]*\.)+",
        "\\b[סמרכ][‛'’׳]",
        "\\b[\\p{L}\\u0591-\\u05BD\\u05BF\\u05C1\\u05C2\\u05C7]+(?:[‛’“'\"״׳][\\p{L}\\u0591-\\u05BD\\u05BF\\u05C1\\u05C2\\u05C7]+)+\\b",
        r"\b\d+(?:[.,]\d+)+\b",
        r"[=+$%€°£#<>]",
        r"\.\.\.",
        r"[\p{P}\p{S}]",
    ),
    # Find and replace, in this order.
    normalise=(
        ("[֑֖֛֢֣֤֥֦֧֪֚֭֮֒֓֔֕֗֘֙֜֝֞֟֠֡֨֩֫֬֯]", ""),
        ("[ְֱֲֳִֵֶַָֹֺֻּֽֿׁׂׅׄ]", ""),
        ("װ", "וו"),
        ("ױ", "וי"),
        ("[ײײַ]", "יי"),
        ("[ﭏאָﬞאַאָ]", "א"),
        ("יִ", "י"),
        ("וּ", "ו"),
        ("[בֿבּ]", "ב"),
        ("[כֿכּ]", "כ"),
        ("[שׁשׂ]", "ש"),
        ("[תּ]", "ת"),
        ("-", "־"),
        ("[‛'’׳]", "'"),
        ("[“«»״]", "\""),
        ("·", ""),
    ),
    query_replacements=(*QUOTES, (r'\b((?:\p{L}\p{M}*)+)"((?:\p{L}\p{M}*)+)\b', r"\1\2")),
    stop_words=frozenset(
        (
            "אַ",
            "אַן",
            "און",
            "איז",
            "אין",
            "אױף",
            "בין",
            "ביסט",
            "ביסטו",
            "בײַ",
            "געװען",
            "די",
            "דעם",
            "דער",
            "האָב",
            "האָבן",
            "האָט",
            "זי",
            "זענען",
            "זײַן",
            "זײַנען",
            "מע",
            "מען",
            "מ‛",
            "ס‛",
            "עס",
            "ער",
            "פֿון",
            "ר‛",
        )
    ),
    synonyms=(("איך", "כ‛"), ("גאָרניט", "גאָרנישט"), ("געװען", "געװעזן"), ("זײַט", "זענט"), ("זײַנען", "זענען"), ("מע", "מען", "מ‛"), ("ניט", "נישט"), ("ניטאָ", "נישטאָ"), ("עס", "סע", "ס‛"), ("ער", "ר‛")),
    right_to_left=True,
    term_filter=_without_quotes,
    decompose=decomposed,
    query_variants=lambda term: from_latin(term),
)

LANGUAGES = {x.locale: x for x in (PLAIN, ENGLISH, YIDDISH)}


def folded(text: str) -> str:
    """Case, accents, width and dashes made alike, for metadata."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return regex.sub(r"\p{Pd}", "-", plain).casefold()
