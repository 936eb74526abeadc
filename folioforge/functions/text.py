"""Whitespace, slug, heading, transliteration and redaction expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space. Java's \s is ASCII-only without (?U), and leaves out the four separators 1C-1F.
SPACE = r"\s\x1c-\x1f"
# The same characters as a plain string, for functions that take a set of characters.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NON_ASCII = r"[^\x00-\x7F]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines a Column wherever it is mentioned; binding keeps rarely taken branches that mention
    their input many times from growing into huge trees.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    """False for null, empty and whitespace-only text; stops at the first visible character."""
    return F.coalesce(text.rlike(rf"(?U)[^{SPACE}]"), F.lit(False))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def slugify(text: Column, max_length: int = 80) -> Column:
    hyphens = F.regexp_replace(F.lower(text), rf"(?U)[{SPACE}_]+", "-")
    kept = F.regexp_replace(hyphens, "[^a-z0-9-]", "")
    trimmed = F.btrim(F.regexp_replace(kept, "-{2,}", "-"), F.lit("-"))
    # Too long: back to the last hyphen among the first max_length characters, else a hard cut.
    at_hyphen = F.regexp_replace(trimmed, rf"^(?=.{{{max_length + 1}}})(.{{1,{max_length - 1}}})-.*$", "$1")
    return F.regexp_replace(at_hyphen, rf"^(.{{{max_length}}}).+$", "$1")


def first_heading(markdown: Column) -> Column:
    """Text of the first level-one heading, or null. ``d`` makes only ``\\n`` a line end."""
    found = F.regexp_extract(markdown, rf"(?mdU)^#[{SPACE}]+(.+)$", 1)
    return none_if_empty(strip(found))


@lru_cache(maxsize=1)
def _ascii_expansions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves ASCII: (to one character, to several)."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(ascii_part) == 1:
            single[char] = ascii_part
        elif ascii_part:
            several[char] = ascii_part
    return single, several


def transliterate(text: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII.

    Spark has no normalisation function, but the ASCII part of a decomposition depends on one character at
    a time, so a character table gives the same answer without leaving the JVM. Only the distinct non-ASCII
    characters of a text are looked up, and each is then replaced in the whole text at once.
    """
    single, several = _ascii_expansions()
    expansions = F.str_to_map(
        F.lit("\x01".join(f"{char}\x02{ascii_part}" for char, ascii_part in several.items())),
        F.lit("\x01"),
        F.lit("\x02"),
    )

    def ascii_part(char: Column) -> Column:
        mapped = F.translate(char, "".join(single), "".join(single.values()))
        return F.struct(
            char.alias("char"), F.when(mapped != char, mapped).otherwise(F.try_element_at(expansions, char)).alias("ascii")
        )

    present = F.array_distinct(F.regexp_extract_all(text, F.lit(NON_ASCII), F.lit(0)))
    known = F.filter(F.transform(present, ascii_part), lambda pair: pair["ascii"].isNotNull())
    replaced = F.aggregate(known, text, lambda done, pair: F.replace(done, pair["char"], pair["ascii"]))
    return F.when(text.rlike(NON_ASCII), F.regexp_replace(replaced, f"{NON_ASCII}+", "")).otherwise(text)


def redact_secrets(text: Column) -> Column:
    # What counts as a secret, and its replacement. The order matters.
    for pattern in (rf"Bearer[{SPACE}]+[^{SPACE}]+", rf"Authorization:[{SPACE}]*[^{SPACE}]+"):
        text = F.regexp_replace(text, f"(?U){pattern}", "[REDACTED]")
    return text
