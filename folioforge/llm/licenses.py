"""License scans: a positional index of rare words.

Each licence template is entered in the index under the rarest word of its key phrase, by document frequency in the
scanned corpus, with its position. A text's occurrences of such words are looked up, template word and text word give
the place where the template would begin, and the template is compared there word by word. All words of a key phrase
are mandatory, so every place holds its rarest one and none is missed. Everything happens within the row of a text; nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import identified

# Separators of words once A-Z are lower-cased; A-Z themselves do not separate.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words``: the licence notice; ``key``: the words in it that must stand literally; ``whole``: all must."""

    label: str
    words: str
    key: str
    whole: bool = False


BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]
NOTICES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
]
# Share of a notice's words that must stand in place.
NOTICE_SHARE = 0.7


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also below lambdas."""
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    """Words of a text, lower-cased. Splitting comes first, so case cannot change what separates words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    return F.filter(parts, lambda w: w != "")


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each licence word stands, and the number of texts. At most one row for each word comes back."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    rows = texts.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {row["word"]: row["count"] for row in rows}
    return counts, counts.pop("", 0)


def key_places(template: Template) -> range:
    """Positions of the key phrase among the template's words."""
    words, key = template.words.split(), template.key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return range(at, at + len(key))


def postings(templates: list[Template], counts: dict[str, int], total: int) -> list[tuple[str, int, int]]:
    """(word, template, position) of the word each template is looked up by: that of highest inverse frequency in its key."""
    entries = []
    for number, template in enumerate(templates):
        words = template.words.split()
        rarest = min(key_places(template), key=lambda i: (-math.log((total + 1) / (counts.get(words[i], 0) + 1)), i))
        entries.append((words[rarest], number, rarest))
    return entries


def scan_licenses(docs: DataFrame, base: list[Template] = BASE, notices: list[Template] = NOTICES) -> DataFrame:
    """Licences in each text: (doc_id, n_words, places, found).

    ``places``: every place of a base phrase, as (start, label), words counted from 0. ``found``: every notice of which
    at least 70 % of the words stand in place, among them all words of its key phrase, as (start, label, share). Null and empty texts have no words and no licences; one
    row comes back for each row, and a null doc_id stays null.
    """
    templates = [*base, *notices]
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    texts = identified(docs).select("doc_id", text_words(F.col("text")).alias("words"))
    entries = postings(templates, *document_frequencies(texts, vocabulary))
    rare = sorted({word for word, _, _ in entries})

    def matches(words: Column, start: Column, number: int) -> Column:
        """Words of the template that stand in place, key words first failing the whole."""
        template = templates[number]
        expected, key = template.words.split(), key_places(template)
        in_place = [F.coalesce(F.get(words, start + i) == w, F.lit(False)) for i, w in enumerate(expected)]
        required = in_place[key[0]]
        for test in in_place[key[0] + 1 : key[-1] + 1]:
            required = required & test
        share = sum((test.cast("int") for test in in_place[1:]), in_place[0].cast("int")) / F.lit(float(len(expected)))
        return F.when((start >= 0) & required, share).otherwise(F.lit(0.0))

    def lookup(words: Column, numbers: range) -> Column:
        """Candidates (template, start) from the index, verified."""

        def begins(positions: Column, word: str, offset: int) -> Column:
            return F.transform(F.filter(positions, lambda p: F.get(words, p) == word), lambda p: p - offset)

        def compared(starts: Column, number: int) -> Column:
            label = F.lit(templates[number].label).alias("label")
            return F.transform(starts, lambda s: F.struct(s.alias("start"), label, matches(words, s, number).alias("share")))

        def verified(positions: Column) -> Column:
            found = []
            for number in numbers:
                starts = F.flatten(F.array(*[begins(positions, w, i) for w, n, i in entries if n == number]))
                found.append(compared(F.array_distinct(starts), number))
            return F.flatten(F.array(*found))

        return let(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get(words, p).isin(rare)), verified)

    def scanned(words: Column) -> Column:
        places = F.filter(lookup(words, range(len(base))), lambda x: x["share"] >= 1.0)
        notes = F.filter(lookup(words, range(len(base), len(templates))), lambda x: x["share"] >= NOTICE_SHARE)
        return F.struct(F.size(words).cast("long").alias("n_words"), places.alias("places"), notes.alias("found"))

    # sequence() counts down below zero words, so texts without words are kept apart.
    empty = "struct<n_words:bigint,places:array<struct<start:int,label:string,share:double>>,found:array<struct<start:int,label:string,share:double>>>"
    nothing = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().alias("places"), F.array().alias("found")).cast(empty)
    scan = F.when(F.size("words") > 0, let(F.col("words"), scanned).cast(empty)).otherwise(nothing)
    return texts.select("doc_id", F.inline(F.array(scan)))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score of each scanned text."""
    starts = F.transform("places", lambda x: x["start"].cast("long"))
    base, found = F.transform("places", lambda x: x["label"]), F.transform("found", lambda x: x["label"])
    shares = F.transform(F.concat("places", "found"), lambda x: x["share"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
